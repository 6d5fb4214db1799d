"""Lexers: text -> (kinds, gaps, starts). kinds are terminal names without the final EOF, gaps[i] says whether a statement
may end before token i without a terminator (length one more than kinds, for EOF), starts are character offsets.

What no language knows becomes ERR; a whole line that is a version-control conflict marker becomes MARK.
"""

from __future__ import annotations

import re

MARK = r"(?P<MARK>^[ \t]*(?:(?:<{7}|>{7}|\|{7})(?:[ \t][^\n]*)?$|={7}[ \t]*\r?$))"

JS_RESERVED = frozenset("await break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield let static implements interface package private protected public".split())
JS_CONTEXT = frozenset("as async from get of set type abstract declare readonly keyof infer is asserts satisfies unique namespace module global override out accessor require".split())
_JS = re.compile(
    MARK
    + r"""|[ \t\v\f\xa0\ufeff]*(?:(?P<nl>\r\n?|[\n\u2028\u2029])|(?P<lc>//[^\n\r\u2028\u2029]*)|(?P<bc>/\*(?:[^*]|\*(?!/))*\*/)
|(?P<id>(?:[^\W\d]|\$|\\u(?:[0-9A-Fa-f]{4}|\{[0-9A-Fa-f]+\}))(?:[\w$\u200c\u200d]|\\u(?:[0-9A-Fa-f]{4}|\{[0-9A-Fa-f]+\}))*)
|(?P<num>0[xX][0-9A-Fa-f](?:_?[0-9A-Fa-f])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:(?:0|[1-9](?:_?\d)*)n|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d+)?|\d(?:_?\d)*\.?(?:[eE][+-]?\d+)?))(?![\w$])
|(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')|(?P<priv>\#[^\W\d][\w$]*)|(?P<tpl>`)
|(?P<op>\.\.\.|=>|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[{}()\[\].;,<>+\-*/%&|^!~?:=@]))|(?P<ws>[ \t\v\f\xa0\ufeff]+)""",
    re.M | re.X,
)
_JS_WORDS = {w: w for w in JS_RESERVED | JS_CONTEXT}
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_JS_TEXT = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_ENDS = frozenset(["NAME", "NUM", "STR", "TPL", "TPL_TAIL", "REGEX", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--"]) | JS_CONTEXT


def lex_js(text: str) -> tuple[list[str], list[bool], list[int]]:
    kinds, gaps, starts = [], [], []
    pos, n, gap, prev = 0, len(text), True, ""
    braces: list[str] = []
    parens: list[bool] = []
    control = False
    if text.startswith("#!"):
        pos = (text.find("\n") + 1) or n
    match, words = _JS.match, _JS_WORDS.get

    def add(kind: str, at: int) -> None:
        nonlocal gap, prev
        kinds.append(kind)
        gaps.append(gap or kind == "}")
        starts.append(at)
        gap, prev = False, kind

    def template(at: int, head: bool) -> int:
        e = _JS_TEXT.match(text, at).end()
        if e >= n:
            add("ERR", at)
            return n
        if text[e] == "`":
            add("TPL" if head else "TPL_TAIL", at)
            return e + 1
        add("TPL_HEAD" if head else "TPL_MID", at)
        braces.append("`")
        return e + 2

    while pos < n:
        m = match(text, pos)
        if m is None:
            c = text[pos]
            if text.startswith("/*", pos):
                add("ERR", pos)
                break
            add("ERR", pos)
            if c in "\"'":  # a string that does not close on its line
                e = text.find("\n", pos)
                pos = n if e < 0 else e
            else:
                pos += 1
            continue
        g, at, pos = m.lastgroup, m.lastindex, m.end()
        if g == "id":
            w = m[at]
            kind = words(w, "NAME")
            kinds.append(kind)
            gaps.append(gap)
            starts.append(m.start(at))
            gap, prev = False, "NAME" if prev in (".", "?.") and w != "of" else kind
        elif g == "nl":
            gap = True
        elif g in ("lc", "ws"):
            continue
        elif g == "bc":
            gap = gap or "\n" in m[at]
        elif g == "op":
            w, s = m[at], m.start(at)
            if w in ("/", "/=") and (prev not in _ENDS or (prev == ")" and control) or (prev == "}" and gap)):
                r = _JS_REGEX.match(text, s)
                if r:
                    add("REGEX", s)
                    pos = r.end()
                    continue
            if w == "}" and braces and braces[-1] == "`":
                braces.pop()
                pos = template(pos, False)
                continue
            if w == "{":
                braces.append("{")
            elif w == "}":
                if braces:
                    braces.pop()
            elif w == "(":
                parens.append(prev in ("if", "while", "for", "with"))
            elif w == ")":
                control = parens.pop() if parens else False
            kinds.append(w)
            gaps.append(gap or w == "}")
            starts.append(s)
            gap, prev = False, w
        elif g == "tpl":
            pos = template(pos, True)
        else:
            add({"num": "NUM", "str": "STR", "priv": "PRIVATE", "MARK": "MARK"}[g], m.start(at))
    gaps.append(True)
    return kinds, gaps, starts


RUST_KEYWORDS = frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while abstract become box do final macro override priv typeof unsized virtual yield try gen".split())
_RUST = re.compile(
    MARK
    + r"""|(?P<ws>\s*\n)|[ \t]*(?:(?P<lc>//[^\n]*)|(?P<bc>/\*)
|(?P<raw>b?c?r(?P<h>\#*)"[\s\S]*?"(?P=h))|(?P<str>[bc]?"(?:[^"\\]|\\[\s\S])*")|(?P<chr>b?'(?:[^'\\\n\r\t]|\\(?:[nrt\\0'"]|x[0-9A-Fa-f]{2}|u\{[0-9A-Fa-f_]{1,8}\}))')|(?P<life>'[^\W\d]\w*(?!'))
|(?P<id>(?:r\#)?[^\W\d]\w*)
|(?P<num>0x[0-9A-Fa-f_]+(?:[iu](?:8|16|32|64|128|size))?|0o[0-7_]+(?:[iu](?:8|16|32|64|128|size))?|0b[01_]+(?:[iu](?:8|16|32|64|128|size))?|\d[\d_]*(?:\.\d[\d_]*(?:[eE][+-]?[\d_]+)?|[eE][+-]?[\d_]+|\.(?![.\w]))?(?:[iuf](?:8|16|32|64|128|size))?)(?!\w)
|(?P<op>\.\.\.|\.\.=|<<=|\.\.|::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|[{}()\[\].;,<>+\-*/%&|^!?:=@\#$~]))|(?P<blank>\s+)""",
    re.M | re.X,
)
_RUST_WORDS = {w: w for w in (*RUST_KEYWORDS, "_", "union", "auto", "macro_rules", "safe")}
_RUST_C = re.compile(r"/\*|\*/")


def lex_rust(text: str) -> tuple[list[str], list[bool], list[int]]:
    kinds, starts = [], []
    pos, n = 0, len(text)
    if text.startswith("\ufeff"):
        pos = 1
    if text.startswith("#!", pos) and not re.match(r"#!\s*\[", text[pos : pos + 40]):
        pos = (text.find("\n") + 1) or n
    match, words = _RUST.match, _RUST_WORDS.get
    while pos < n:
        m = match(text, pos)
        if m is None:
            kinds.append("ERR")
            starts.append(pos)
            pos = n if text[pos] == '"' else pos + 1
            continue
        g, at, pos = m.lastgroup, m.lastindex, m.end()
        if g in ("ws", "lc", "blank"):
            continue
        s = m.start(at)
        if g == "bc":
            depth = 1
            while depth:
                c = _RUST_C.search(text, pos)
                if c is None:
                    kinds.append("ERR")
                    starts.append(s)
                    pos = n
                    break
                depth += 1 if c[0] == "/*" else -1
                pos = c.end()
            continue
        if g == "id":
            kind = words(m[at], "NAME")
        elif g == "op":
            kind = m[at]
        else:
            kind = {"raw": "STR", "h": "STR", "str": "STR", "chr": "CHAR", "life": "LIFETIME", "num": "NUM", "MARK": "MARK"}[g]
        kinds.append(kind)
        starts.append(s)
    return kinds, [False] * (len(kinds) + 1), starts


GO_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_GO_END = frozenset(["NAME", "NUM", "STR", "CHAR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
_GO = re.compile(
    MARK
    + r"""|[ \t\r\ufeff]*(?:(?P<nl>\n)|(?P<lc>//[^\n]*)|(?P<bc>/\*(?:[^*]|\*(?!/))*\*/)
|(?P<str>"(?:[^"\\\n]|\\[abfnrtv\\"]|\\[0-7]{3}|\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*"|`[^`]*`)
|(?P<chr>'(?:[^'\\\n]|\\[abfnrtv\\']|\\[0-7]{3}|\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})')
|(?P<id>[^\W\d]\w*)|(?P<num>(?:0[xX][0-9A-Fa-f_]+(?:\.[0-9A-Fa-f_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?)
|(?P<op>\.\.\.|<<=|>>=|&\^=|&\^|<-|:=|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|[{}()\[\].;,<>+\-*/%&|^!:=~]))|(?P<ws>[ \t\r\ufeff]+)""",
    re.M | re.X,
)
_GO_WORDS = {w: w for w in GO_KEYWORDS}


def lex_go(text: str) -> tuple[list[str], list[bool], list[int]]:
    kinds, starts = [], []
    pos, n = 0, len(text)
    match, words = _GO.match, _GO_WORDS.get
    prev = ""
    while pos < n:
        m = match(text, pos)
        if m is None:
            kinds.append("ERR")
            starts.append(pos)
            prev = "ERR"
            if text[pos] == "`" or text.startswith("/*", pos):
                break
            e = text.find("\n", pos) if text[pos] in "\"'" else pos + 1
            pos = n if e < 0 else e
            continue
        g, at, pos = m.lastgroup, m.lastindex, m.end()
        if g == "op":
            kind = m[at]
        elif g == "id":
            kind = words(m[at], "NAME")
        elif g in ("ws", "lc"):
            continue
        elif g == "nl" or g == "bc":
            if prev in _GO_END and (g == "nl" or "\n" in m[at]):
                kinds.append(";")
                starts.append(m.start(at))
                prev = ";"
            continue
        else:
            kind = {"str": "STR", "chr": "CHAR", "num": "NUM", "MARK": "MARK"}[g]
        kinds.append(kind)
        starts.append(m.start(at))
        prev = kind
    if prev in _GO_END:
        kinds.append(";")
        starts.append(n)
    return kinds, [False] * (len(kinds) + 1), starts


PY_KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_PY_PREFIX = r"(?:[rR][bBfFtT]?|[bBfFtT][rR]?|[uU])?"
_PY = re.compile(
    MARK
    + rf"""|[ \t\f]*(?:(?P<nl>\r\n?|\n)|(?P<ws>\\(?:\r\n?|\n))|(?P<lc>\#[^\n\r]*)
|(?P<str>{_PY_PREFIX}(?:\"\"\"|'''|"|'))
|(?P<num>(?:0[xX](?:_?[0-9A-Fa-f])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?))(?!\w*\d|[A-Za-z_](?<!(?:\d|\.)(?:i|o|a|n|e|f)))
|(?P<id>[^\W\d]\w*)
|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\*\*|//|<<|>>|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[{{}}()\[\].;,<>+\-*/%&|^~:=@]))|(?P<blank>[ \t\f]+)""",
    re.M | re.X,
)
_PY_WORDS = {w: w for w in (*PY_KEYWORDS, "match", "case", "type", "_")}
_PY_BODY = {q: re.compile(rf"(?:[^\\{q}]|\\[\s\S])*{q}" if len(q) == 3 else rf"(?:[^\\{q}\n\r]|\\(?:\r\n|[\s\S]))*{q}") for q in ('"', "'")}
_PY_BODY |= {q: re.compile(rf"(?:[^\\{q[0]}]|\\[\s\S]|{q[0]}(?!{q[:2]}))*{q}") for q in ('"""', "'''")}
_PY_BLANK = re.compile(r"[ \t\f]*(?:#[^\n\r]*)?(?:\r\n?|\n|\Z)")
_PY_PAD = re.compile(r"[ \t\f]*")


def _py_string(text: str, pos: int, prefix: str, quote: str) -> int:
    """End of a string literal that opened before pos, or -1. Replacement fields of f-strings may hold strings of any quote."""
    if "f" not in prefix and "t" not in prefix:
        m = _PY_BODY[quote].match(text, pos)
        return m.end() if m else -1
    n, raw = len(text), "r" in prefix
    while pos < n:
        c = text[pos]
        if text.startswith(quote, pos):
            return pos + len(quote)
        if c == "\\" and not (raw and text[pos + 1 : pos + 2] in "{}"):
            pos += 2
        elif c == "{":
            if text.startswith("{{", pos):
                pos += 2
                continue
            pos = _py_field(text, pos + 1, quote)
            if pos < 0:
                return -1
        elif c == "}":
            if not text.startswith("}}", pos):
                return -1
            pos += 2
        elif c in "\r\n" and len(quote) == 1:
            return -1
        else:
            pos += 1
    return -1


def _py_field(text: str, pos: int, quote: str) -> int:
    """End of a replacement field, after its brace."""
    n, depth, at = len(text), 0, pos
    while pos < n:
        c = text[pos]
        m = re.compile(_PY_PREFIX + r"(?:\"\"\"|'''|\"|')").match(text, pos) if c in "\"'rRbBfFuU" else None
        if m and (c in "\"'" or not (pos > at and (text[pos - 1].isalnum() or text[pos - 1] == "_"))):
            q = m[0].lstrip("rRbBfFuUtT")
            pos = _py_string(text, m.end(), m[0][: -len(q)].lower(), q)
            if pos < 0:
                return -1
            continue
        if c in "([{":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "}":
            if depth == 0:
                return -1 if not text[at:pos].strip() else pos + 1
            depth -= 1
        elif c == ":" and depth == 0:
            pos += 1
            while pos < n:  # the format; fields may nest
                c = text[pos]
                if c == "{":
                    pos = _py_field(text, pos + 1, quote)
                    if pos < 0:
                        return -1
                elif c == "}":
                    return pos + 1
                elif text.startswith(quote, pos) or (c in "\r\n" and len(quote) == 1):
                    return -1
                else:
                    pos += 1
            return -1
        pos += 1
    return -1


def lex_python(text: str) -> tuple[list[str], list[bool], list[int]]:
    kinds, starts = [], []
    pos, n, depth = 0, len(text), 0
    indents: list[tuple[int, int]] = [(0, 0)]
    fresh = True
    if text.startswith("\ufeff"):
        pos = 1
    match, words = _PY.match, _PY_WORDS.get
    add = lambda k, s: (kinds.append(k), starts.append(s))
    while pos < n:
        if fresh and not depth:
            b = _PY_BLANK.match(text, pos)
            if b:
                if b.end() == pos:
                    break
                pos = b.end()
                continue
            pad = _PY_PAD.match(text, pos)
            col = alt = 0
            if not pad[0].strip(" "):
                col = alt = pad.end() - pos
            for c in pad[0] if not col else "":
                if c == "\t":
                    col, alt = (col // 8 + 1) * 8, alt + 1
                elif c == "\f":
                    col = alt = 0
                else:
                    col, alt = col + 1, alt + 1
            fresh = False
            if not text[pad.end()] == "\\" and not (m0 := match(text, pos)) or (m0 := match(text, pos)) and m0.lastgroup == "MARK":
                pass  # a marker line has no indentation of its own
            elif col > indents[-1][0]:
                add("INDENT" if alt > indents[-1][1] else "ERR", pos)
                indents.append((col, alt))
            else:
                while col < indents[-1][0]:
                    indents.pop()
                    add("DEDENT", pos)
                if (col, alt) != indents[-1]:
                    add("ERR", pos)
        m = match(text, pos)
        if m is None:
            add("ERR", pos)
            pos += 1
            continue
        g, at, pos = m.lastgroup, m.lastindex, m.end()
        s = m.start(at)
        if g == "id":
            kinds.append(words(m[at], "NAME"))
            starts.append(s)
        elif g in ("ws", "lc", "blank"):
            continue
        elif g == "nl":
            if not depth:
                add("NEWLINE", s)
                fresh = True
        elif g == "str":
            q = m[at].lstrip("rRbBfFuUtT")
            e = _py_string(text, pos, m[at][: -len(q)].lower(), q)
            if e < 0:
                add("ERR", s)
                e = n if len(q) == 3 else text.find("\n", pos)
                pos = n if e < 0 else e
            else:
                add("STR", s)
                pos = e
        elif g == "op":
            w = m[at]
            if w in "([{":
                depth += 1
            elif w in ")]}":
                depth = max(0, depth - 1)
            kinds.append(w)
            starts.append(s)
        else:
            add("NUM" if g == "num" else "MARK", s)
    if kinds and kinds[-1] not in ("NEWLINE", "DEDENT"):
        add("NEWLINE", n)
    for _ in indents[1:]:
        add("DEDENT", n)
    return kinds, [False] * (len(kinds) + 1), starts


_JSON = re.compile(
    MARK + r"""|(?P<ws>[ \t\r\n]*\n|[ \t\r\n]+)|(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*")|(?P<num>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?![\w.])|(?P<id>[A-Za-z]+)|(?P<op>[{}\[\],:])""",
    re.M | re.X,
)


def lex_json(text: str) -> tuple[list[str], list[bool], list[int]]:
    kinds, starts = [], []
    pos, n = 0, len(text)
    match = _JSON.match
    while pos < n:
        m = match(text, pos)
        if m is None:
            kinds.append("ERR")
            starts.append(pos)
            e = text.find("\n", pos) if text[pos] == '"' else pos + 1
            pos = n if e < 0 else e
            continue
        g = m.lastgroup
        if g != "ws":
            w = m[0]
            kinds.append(w if g == "op" or w in ("true", "false", "null") else {"str": "STR", "num": "NUM", "MARK": "MARK", "id": "ERR"}[g])
            starts.append(pos)
        pos = m.end()
    return kinds, [False] * (len(kinds) + 1), starts
