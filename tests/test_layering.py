import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
ORDER = ["dims", "functions", "store", "session", "operators", "sources", "streaming", "plans", "cli"]


def imports(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module:
            yield node.module
            yield from (f"{node.module}.{a.name}" for a in node.names)


def test_nothing_imports_the_llm_package():
    for path in (ROOT / "provelight").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not [m for m in imports(path) if "llm" in m.split(".")], path


def test_lower_layers_do_not_import_higher_ones():
    for path in (ROOT / "provelight").rglob("*.py"):
        own = path.relative_to(ROOT / "provelight").parts[0].removesuffix(".py")
        if own not in ORDER:
            continue
        for module in imports(path):
            parts = module.split(".")
            if parts[0] == "provelight" and len(parts) > 1 and parts[1] in ORDER:
                assert ORDER.index(parts[1]) <= ORDER.index(own), (path, module)
