"""Fixed values of the scoring model: names, caps, weights, axes and phrases."""

FEATURES = (
    "nesting_depth",
    "length",
    "token_entropy",
    "naming_entropy",
    "cyclomatic_proxy",
    "use_def_distance",
    "name_flow",
    "call_graph_shape",
    "exception_density",
    "parse_error",
    "global_reach",
    "attr_reach",
    "call_graph_depth",
)
CAPS = {
    "nesting_depth": 8.0,
    "length": 200.0,
    "token_entropy": 6.0,
    "naming_entropy": 5.0,
    "cyclomatic_proxy": 3.0,
    "use_def_distance": 30.0,
    "name_flow": 12.0,
    "call_graph_shape": 4.0,
    "exception_density": 0.5,
    "parse_error": 1.0,
    "global_reach": 100.0,
    "attr_reach": 80.0,
    "call_graph_depth": 4.0,
}
LINEAR_WEIGHTS = {
    "nesting_depth": 0.15,
    "length": 0.03,
    "token_entropy": 0.05,
    "naming_entropy": 0.05,
    "cyclomatic_proxy": 0.12,
    "use_def_distance": 0.08,
    "name_flow": 0.08,
    "call_graph_shape": 0.10,
    "exception_density": 0.05,
    "parse_error": 0.50,
    "global_reach": 0.10,
    "attr_reach": 0.08,
    "call_graph_depth": 0.06,
}
LINEAR_THRESHOLD = 0.55
PERCENTILE_THRESHOLD = 0.90

#: axis -> (member features, 95th percentile of their mean over a trusted corpus)
AXES = {
    "complexity": (("nesting_depth", "cyclomatic_proxy", "length"), 0.37),
    "tangled_state": (("use_def_distance", "name_flow", "global_reach", "attr_reach"), 0.63),
    "hidden_calls": (("call_graph_shape", "call_graph_depth"), 0.50),
    "exception_surface": (("exception_density",), 0.06),
    "naming": (("token_entropy", "naming_entropy"), 0.68),
    "malformed": (("parse_error",), 0.05),
}
PHRASES = {
    "complexity": "deeply nested / branchy control flow",
    "tangled_state": "variables reach across long distances",
    "hidden_calls": "delegates to opaque calls",
    "exception_surface": "heavy exception handling",
    "naming": "unusual identifier density",
    "malformed": "doesn't parse as valid Python — likely a typo",
}
#: Names whose calls weigh 0.5.
BUILTIN_CALLS = (
    "print", "len", "range", "str", "int", "float", "list", "dict", "set", "tuple", "map", "filter", "zip", "enumerate",
    "sorted", "min", "max", "sum", "abs", "round", "any", "all", "isinstance", "type", "iter", "next", "open", "input",
)
SKIP_DIRS = (
    ".git", ".venv", "venv", ".env", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", "node_modules",
    "dist", "build", ".idea", ".vscode", "site-packages", ".tox", ".nox",
)
SKIP_FILES = ("setup.py", "conftest.py", "*_pb2.py", "*_pb2_grpc.py")
SKIP_SUBSTRINGS = ("/test", "test_", "_test.", "/tests/", "/testing/", "/docs/", "/doc/", "/example", "/examples/", "/migrations/", "__pycache__", ".pyi", "conftest")
MIN_CHARS, MAX_CHARS = 500, 300_000
#: Comments that mark a line as noticed by its authors, first match wins.
MARKERS = (
    ("noqa", r"#\s*noqa\b"),
    ("type_ignore", r"#\s*type:\s*ignore\b"),
    ("pyright", r"#\s*pyright:\s*ignore\b"),
    ("pragma_no_cover", r"#\s*pragma:\s*no\s*cover\b"),
    ("nosec", r"#\s*nosec\b"),
    ("mypy_ignore", r"#\s*mypy:\s*ignore\b"),
    ("todo_refactor", r"(?i)#\s*(TODO|FIXME|XXX).*(refactor|cleanup|simplify|complex|nested)"),
)
SIMPLE_CLASSES = ("constant", "logn", "linear")
COMPLEX_CLASSES = ("nlogn", "quadratic", "cubic", "np")
