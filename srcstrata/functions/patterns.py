"""Declaration patterns. java.util.regex evaluates them, one line at a time."""

# --- fixed values: results depend on these patterns being exactly so ---------
CLASS = r"\b(?:class|interface|enum|record)\s+([A-Za-z_$][\w$]*)"
PYTHON_CLASS = r"^\s*class\s+([A-Za-z_][\w]*)"
JAVA_LIKE_METHOD = (r"\b([A-Za-z_$][\w$]*)\s*\([^;{}]*\)\s*(?:throws\s+[\w.,\s]+)?\{?")
FUNCTION = r"\bfunction\s+([A-Za-z_$][\w$]*)\s*\("
ARROW_FUNCTION = (r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?"
                  r"(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>")
PYTHON_METHOD = r"^\s*def\s+([A-Za-z_][\w]*)\s*\("
CONTROL_KEYWORDS = ["if", "for", "while", "switch", "catch", "return", "new", "throw", "else",
                    "do"]
IDENTIFIER = r"[A-Za-z_$][\w$]*"

# JAVA_LIKE_METHOD in linear time. A match never crosses ; { } and its parentheses end at the last ) before
# the next of them, so a line cut there has at most one match a piece: the first identifier, not tried again
# from its middle, that stands before a ( to the left of that last ).
STATEMENT_END = r"[;{}]"
METHOD_HEAD = r"(?<![\w$])(?>[\w$]*?\b([A-Za-z_$][\w$]*+))\s*+\("
