"""Fixed values.

Word lists, patterns and constants the results depend on.  They are stated as
they must be, in one place; nothing here is computed.  Patterns are written in
the common regular-expression notation with Unicode ``\\w`` and ``\\s``;
``text.java_regex`` turns them into what Spark's engine needs.
"""

# ---------------------------------------------------------------- file tree

IGNORED_DIRS = (
    ".venv", ".git", "__pycache__", ".idea", "build", "dist", "graphify-out",
    ".pytest_cache", "migrations", "node_modules", ".dist-info", "site-packages",
    "__mocks__", "perf", "release", ".claude", "output", "target", "bin", "obj",
    ".gradle", ".vscode", ".vs", "Pods", ".build", "DerivedData",
)

# (substrings of the lower-cased file name, node type); the first hit wins
FILE_CLASSES = (
    (("component", "screen", "provider"), "component"),
    (("router", "route"), "router"),
    (("service",), "service"),
    (("model", "schema"), "model"),
    (("test", "spec"), "test"),
    (("index", "main"), "main"),
    (("grpc",), "grpc"),
)
DEFAULT_FILE_CLASS = "file"

ALIAS_SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")

# ------------------------------------------------------------ graph analytics

BUILTIN_TYPES = ("int", "str", "bool", "float", "bytes", "list", "dict", "set", "tuple", "None")

PAGERANK_ALPHA = 0.85
PAGERANK_TOLERANCE = 1e-6
PAGERANK_MAX_ROUNDS = 100
COMMUNITY_SEED = 42
COMMUNITY_SKIP_TYPES = ("unresolved", "folder")

IMPORTANT_TYPES = (
    "file", "component", "router", "service", "model", "main",
    "react_component", "react_hook", "nestjs_controller", "nestjs_service",
    "nestjs_module", "nestjs_endpoint", "class", "function", "interface",
    "type_alias", "enum", "django_model", "django_view", "fastapi_endpoint",
    "fastapi_schema",
)
NOISE_SYMBOLS = (
    "len", "fmt", "log", "err", "req", "res", "ctx", "val", "key", "obj",
    "arr", "str", "int", "map", "set",
)
MIN_RANK_IMPORTANT = 0.000001
MIN_RANK_OTHER = 0.00001

# ------------------------------------------------------------------ rendering

PAGE_NEIGHBOURS = 25
PAGE_PEERS = 15
INDEX_GOD_NODES = 30
DEFAULT_GOD_NODES = 10
PAGE_NAME_LIMIT = 140
PAGE_NAME_KEEP = 120
PAGE_NAME_DIGEST = 10
EMPTY_PAGE_NAME = "unnamed_node"

# ---------------------------------------------------------- rule-based languages

CPP_CLASS = r"(?:class|struct)\s+(\w+)"
CPP_FUNCTION = r"(?:\w+\s+)?(\w+)\s*\([^)]*\)\s*(?:const\s*)?\{"
CPP_INCLUDE = r'#include\s+[<"](.+?)[>"]'
CPP_NAMESPACE = r"namespace\s+(\w+)"
CPP_NOT_FUNCTIONS = ("if", "for", "while", "switch", "catch", "main")

CSHARP_CLASS = (
    r"(?:public|private|protected|internal|abstract|sealed|static|partial)?\s*"
    r"(?:class|struct|interface|enum|record)\s+(\w+)"
)
CSHARP_METHOD = (
    r"(?:public|private|protected|internal|static|async|override|virtual|abstract)?\s*"
    r"(?:\w+\s+)?(\w+)\s*\([^)]*\)\s*(?:=>|\{)"
)
CSHARP_USING = r"^using\s+([\w.]+);"
CSHARP_NAMESPACE = r"^namespace\s+([\w.]+)"
CSHARP_NOT_METHODS = (
    "if", "for", "while", "switch", "catch", "using", "lock", "checked", "unchecked",
)

DART_WIDGET = r"^class\s+(\w+)\s+extends\s+(?:StatelessWidget|StatefulWidget|Widget)"
DART_CLASS = r"^class\s+(\w+)"
DART_FUNCTION = r"^(?:\w+\s+)?(\w+)\s*\([^)]*\)\s*\{"
DART_IMPORT = r"import\s+['\"](.+?)['\"]"
DART_NOT_FUNCTIONS = ("if", "for", "while", "switch", "catch")

GO_FUNCTION = r"^func\s+(?:\([^)]+\)\s+)?(\w+)\s*\("
GO_STRUCT = r"^type\s+(\w+)\s+struct"
GO_INTERFACE = r"^type\s+(\w+)\s+interface"
GO_QUOTED = r'"([^"]+)"'

JAVA_CLASS = (
    r"(?:public|private|protected|internal|abstract|final|open|data|sealed)?\s*"
    r"(?:class|interface|enum|object)\s+(\w+)"
)
JAVA_METHOD = (
    r"(?:public|private|protected|internal|static|final|override|suspend)?\s*"
    r"(?:fun|def)?\s*(\w+)\s*\([^)]*\)\s*(?::\s*\w+)?\s*(?:\{|=)"
)
JAVA_IMPORT = r"^import\s+([\w.]+)"
JAVA_NOT_METHODS = ("if", "for", "while", "switch", "catch", "when")

PROTO_SERVICE = r"^service\s+(\w+)\s*\{"
PROTO_MESSAGE = r"^message\s+(\w+)\s*\{"
PROTO_RPC = r"^\s*rpc\s+(\w+)\s*\("
PROTO_IMPORT = r'^import\s+"(.+?)";'
PROTO_STUB_SUFFIXES = ("_pb2_grpc.py", ".pb.go")

RUBY_CLASS = r"^\s*class\s+(\w+)"
RUBY_MODULE = r"^\s*module\s+(\w+)"
RUBY_METHOD = r"^\s*def\s+(?:self\.)?(\w+)"
RUBY_REQUIRE = r"require\s+['\"](.+?)['\"]"
RUBY_INCLUDE = r"^\s*include\s+(\w+)"

RUST_FUNCTION = r"^\s*(?:pub\s+)?fn\s+(\w+)"
RUST_STRUCT = r"^\s*(?:pub\s+)?struct\s+(\w+)"
RUST_ENUM = r"^\s*(?:pub\s+)?enum\s+(\w+)"
RUST_TRAIT = r"^\s*(?:pub\s+)?trait\s+(\w+)"
RUST_IMPL = r"^\s*impl\s+(?:<<[^>]+>\s+)?(\w+)"
RUST_USE = r"^\s*use\s+([^;]+);"
RUST_LOCAL_ROOTS = ("self", "super", "crate")

SWIFT_CLASS = (
    r"^(?:public|private|internal|open|final)?\s*"
    r"(?:class|struct|enum|protocol|actor)\s+(\w+)"
)
SWIFT_FUNCTION = (
    r"^(?:public|private|internal|open|static|class|override)?\s*func\s+(\w+)"
)
SWIFT_IMPORT = r"^import\s+(\w+)"

# ------------------------------------------------------------------- Python

PYTHON_LOOSE_CLASS = r"class\s+(\w+)"
PYTHON_LOOSE_DEF = r"def\s+(\w+)"
PYDANTIC_BASES = ("BaseModel", "BaseSettings")
FASTAPI_VERBS = ("get", "post", "put", "delete")

# ------------------------------------------------------ JavaScript / TypeScript

NEST_CLASS_DECORATORS = (
    "Controller", "Injectable", "Service", "Module", "Guard", "Interceptor",
    "Pipe", "Resolver", "Middleware", "Catch", "WebSocketGateway",
)
NEST_ROUTE_DECORATORS = (
    "Get", "Post", "Put", "Delete", "Patch", "Options", "Head", "All",
    "MessagePattern", "EventPattern", "Query", "Mutation", "Subscription",
)
JS_NOISE = (
    "console", "process", "require", "module", "exports", "window", "document", "global",
)
NEXT_DATA_FUNCTIONS = (
    "getServerSideProps", "getStaticProps", "getStaticPaths", "generateMetadata",
)
CLASS_WINDOW = (2000, 1200)
METHOD_WINDOW = (800, 500)
FUNCTION_WINDOW = 1200
RETURNS_MARKUP = r"return\s*\(\s*<"
INTERNAL_PREFIXES = ("@/", "~/", "src/", "./", "../", "packages/", "@")
ALIAS_MARKS = ("@/", "~/", "src/")

# the pattern-only variant
JS_RULE_INTERFACE = r"(?:export\s+)?interface\s+([A-Z]\w+)"
JS_RULE_TYPE = r"(?:export\s+)?type\s+([A-Z]\w+)"
JS_RULE_ENUM = r"(?:export\s+)?(?:const\s+)?enum\s+([A-Z]\w+)"
JS_RULE_CLASS = r"(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+(\w+)"
JS_RULE_FUNCTION = (
    r"(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s+(\w+)\s*\("
)
JS_RULE_VARIABLE = (
    r"^(?:\s*export\s+)?(?:const|let|var)\s+(\w+)\s*(?::\s*[\w<>,.\s|]+)?\s*=\s*"
    r"(?:async\s+)?\(?"
)
JS_RULE_IMPORTS = (
    r"import\s+(?:type\s+)?(?:\{[^}]*\}|[\w*]+|\*\s+as\s+\w+)\s+from\s+['\"]([^'\"]+)['\"]",
    r"import\s*\(\s*['\"]([^'\"]+)['\"]",
    r"require\s*\(\s*['\"]([^'\"]+)['\"]",
)
JS_RULE_NOISE = (
    "console", "process", "require", "module", "exports", "window", "document",
    "Promise", "setTimeout", "setInterval", "JSON", "Math", "Date", "Object",
    "Array", "String", "Number", "Boolean", "Error", "Map", "Set", "Symbol",
    "fetch", "URL", "req", "res", "props", "children",
)
JS_RULE_DECORATORS = (
    "Controller", "Injectable", "Module", "Guard", "Interceptor", "Pipe",
    "Resolver", "Service",
)
JS_RULE_CLASS_WINDOW = (400, 300)
JS_RULE_MARKUP_WINDOW = 800
JS_RULE_RETURNS_MARKUP = r"return\s*\(?\s*<"

# --------------------------------------------------------- extension dispatch
# The rule-based languages have no stated extensions; these are our choice.

PYTHON_EXTENSIONS = (".py",)
JS_EXTENSIONS = (".js", ".jsx", ".ts", ".tsx")
CPP_EXTENSIONS = (".c", ".cc", ".cpp", ".h", ".hpp")
CSHARP_EXTENSIONS = (".cs",)
DART_EXTENSIONS = (".dart",)
GO_EXTENSIONS = (".go",)
JAVA_EXTENSIONS = (".java", ".kt")
PROTO_EXTENSIONS = (".proto",)
RUBY_EXTENSIONS = (".rb",)
RUST_EXTENSIONS = (".rs",)
SWIFT_EXTENSIONS = (".swift",)
