"""Regex building blocks shared by the Spark code and the DuckDB oracle.

Java regexes treat ``\\w``/``\\s`` as ASCII unless ``(?U)`` is given, and RE2
(DuckDB) has no such switch.  Spelling the classes out keeps both engines, and
Python's Unicode ``str`` semantics, on the same characters.
"""

# A word character as Python's Unicode ``\w``: letters, digits, underscore.
WORD = r"[\p{L}\p{N}_]"
# Python ``str.isspace`` characters.
_WS_BODY = (
    r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WS = "[" + _WS_BODY + "]"
NON_WS = "[^" + _WS_BODY + "]"
# Leading or trailing whitespace, for a Python-style strip().
STRIP = "^" + WS + "+|" + WS + "+$"
# Tokens of two or more word characters (a maximal run, like \b\w\w+\b).
TOKEN2 = WORD + "{2,}"
# Any maximal run of word characters.
TOKEN1 = WORD + "+"
URL = "http" + NON_WS + "+"
MENTION = "@" + WORD + "+"
HASHTAG = "#" + WORD + "+"
# Pictographs, dingbats, variation selector and zero-width joiner.
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]"

# The same whitespace set as a plain string, for trim(str, chars).
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")
