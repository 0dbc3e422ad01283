"""How functions, classes and imports begin in source files."""

# How functions begin in brace languages; a later pattern counts if the name before is a keyword.
BRACE_FUNCTIONS = [
    r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*[(<]",
    r"^(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\(",
    r"^(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\w*\s*=>",
    r"^\s+(?:(?:public|private|protected|static|async|override)\s*)*(\w+)\s*\(",
]
# Classes, their methods, interfaces, types and enums in brace languages.
BRACE_CLASS = r"^(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"
BRACE_METHOD = r"^\s+(?:(?:public|private|protected|static|async)\s*)*(\w+)\s*\("
INTERFACE = r"^(?:export\s+)?interface\s+(\w+)"
TYPE, ENUM = r"^(?:export\s+)?type\s+(\w+)", r"^(?:export\s+)?(?:const\s+)?enum\s+(\w+)"
# Functions, classes and their methods in Python.
INDENT_FUNCTION, INDENT_CLASS, INDENT_METHOD = r"^(?:async\s+)?def\s+(\w+)\s*\(", r"^class\s+(\w+)", r"^\s+(?:async\s+)?def\s+(\w+)"
# Signatures in other languages.
SIGNATURES = {
    "go": [r"^func\s+\w+", r"^func\s+\(\w+\s+\*?\w+\)\s+\w+"],
    "rust": [r"^(?:pub\s+)?(?:async\s+)?fn\s+\w+", r"^(?:pub\s+)?struct\s+\w+", r"^(?:pub\s+)?impl\s+", r"^(?:pub\s+)?trait\s+\w+"],
    "java": [r"^\s+(?:(?:public|private|protected|static|final)\s*)*+\s*\w+\s+\w+\s*\(", r"^(?:(?:public|private|protected)\s*)*\s*(?:class|interface|enum)\s+\w+"],
    "csharp": [
        r"^\s+(?:(?:public|private|protected|static|virtual|override|async)\s*)*+\s*\w+\s+\w+\s*\(",
        r"^(?:(?:public|private|protected)\s*)*\s*(?:class|interface|struct|enum)\s+\w+",
    ],
    "cpp": [r"^\w[\w\s*&]+\s+\w+\s*\(", r"^class\s+\w+", r"^struct\s+\w+"],
    "ruby": [r"^\s*def\s+\w+", r"^\s*class\s+\w+", r"^\s*module\s+\w+"],
    "": [r"^\s*(?:function|def|func|fn|sub|method)\s+\w+"],
}
# Import lines of script and Python files, with the module.
SCRIPT_IMPORT = r"""^import\s+.*\s+from\s+['"]([^'"]+)['"]"""
PYTHON_IMPORT, PYTHON_MODULE = r"^(?:import\s+([\w.]+)|from\s+([\w.]+)\s+import)", r"^\w+\s+([\w.]+)"
# Import lines in other languages.
IMPORTS = {
    "go": r'^import\s+["(]', "rust": r"^use\s+", "java": r"^import\s+", "csharp": r"^using\s+", "cpp": r"^#include\s+",
    "ruby": r"^require\s+", "php": r"^(?:require|include|use)\s+",
}
# Fixed value: the first text in triple quotes that begins a line.
DOCSTRING = r"(?ms)^(?:\"\"\"(.*?)\"\"\"|'''(.*?)''')"
