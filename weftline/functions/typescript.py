"""A tolerant scanner for TypeScript source: symbols, calls and imports of one file.

Comments, strings, templates and regular expressions are blanked with every position kept; declarations are then
found by their heads, and their spans give every place its scope. Offsets count UTF-8 bytes, rows and columns from 0.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from .rust import _blank, _match, byte_offsets

_SKIP = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?|(?<=[=(,:;!&|?{}\n])\s*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*", re.S)
_NAME = r"[A-Za-z_$][\w$]*"
_FUNCTION = re.compile(rf"(?:\basync\s+)?\bfunction\b\s*\*?\s*(?P<name>{_NAME})")
_TYPE = re.compile(rf"\b(?P<kw>(?:abstract\s+)?class|interface|enum|type)\s+(?P<name>{_NAME})")
_VALUE = re.compile(rf"\b(?:const|let|var)\s+(?P<name>{_NAME})\s*(?::[^=;]*?)?=\s*(?P<fn>(?:async\s*)?(?:function\b|{_NAME}\s*=>|(?:<[^>]*>\s*)?\())")
_METHOD = re.compile(rf"(?P<head>(?:\b(?:public|private|protected|static|readonly|async|override|get|set|abstract)\s+)*)\*?\s*(?P<name>(?:#|(?<![A-Za-z_$])){_NAME}+)\s*+(?:<[^<>()]*+>)?\s*+\(")
_CALL = re.compile(rf"(?P<dot>\?\.|\.)?\s*(?P<name>(?:#|(?<![A-Za-z_$])){_NAME}+)\s*+(?:<[^<>()=;]*+>)?\s*+(?:\?\.)?\(|\]\s*(?:\?\.)?\(")
_IMPORT = re.compile(r"(?<![\w$.])import\b(?!\s*[(.])")
_QUOTE, _CLAUSE = re.compile(r"[\"'`]"), re.compile(r"(?:\s*type\b)?[\s\w$,{}*=(]*")
_WORDS = frozenset("if for while switch catch return function typeof await yield new delete void in of instanceof throw do else case with async get set constructor".split()) - {"constructor", "async", "get", "set"}
_MODIFIERS = ("public", "private", "protected", "static", "readonly", "async", "override", "get", "set", "abstract")
KIND = {"class": "struct", "interface": "trait", "enum": "enum", "type": "type"}


def mask(src: str) -> str:
    """Source with strings, comments and the like blanked; quotes stay, so that literals are seen as values."""
    def blank(m: re.Match) -> str:
        s = m.group()
        body = _blank(s)
        return s[0] + body[1:-1] + s[-1] if len(s) > 1 and s[0] in "\"'`" and s[-1] == s[0] else body

    return _SKIP.sub(blank, src)


class File:
    def __init__(self, path: str, src: str, scope: str | None = None):
        self.path, self.src, self.t = path, src, mask(src)
        self.lines = [0, *(m.end() for m in re.finditer("\n", src))]
        self.byte = byte_offsets(src)
        self.root = f"file:{scope or path}"
        self.symbols: list[dict] = []
        self.calls: list[dict] = []
        self.imports: list[dict] = []
        #: (start, end, name, kind, whether it opens a scope, whether it is a caller), outermost first
        self.spans: list[tuple[int, int, str, str, bool, bool]] = []
        self.heads: set[int] = set()
        self.find_declarations()
        self.find_calls()
        self.find_imports()

    def place(self, a: int, b: int) -> dict:
        ra, rb = bisect_right(self.lines, a) - 1, bisect_right(self.lines, b) - 1
        x, y = self.byte(a), self.byte(b)
        return {"start_byte": x, "end_byte": y, "start_line": ra, "end_line": rb, "start_col": x - self.byte(self.lines[ra]), "end_col": y - self.byte(self.lines[rb])}

    def before(self, a: int) -> str:
        """What stands before a place: its last word, or else its last sign."""
        s = self.t[max(0, a - 80) : a].rstrip()
        k = len(s)
        while k and (s[k - 1].isalnum() or s[k - 1] in "_$"):
            k -= 1
        return s[k:] or s[-1:]

    def body(self, at: int) -> int:
        """End of the block that follows; of the statement where none does."""
        t, k = self.t, at
        while k < len(t):
            if t[k] == "{":
                return _match(t, k)
            if t[k] in "([":
                k = _match(t, k)
                continue
            if t[k] == ";":
                return k + 1
            k += 1
        return len(t)

    def value_end(self, at: int) -> int:
        """End of an initialiser: before the comma, semicolon or bracket that ends it, or a line end after a block."""
        t, k = self.t, at
        while k < len(t):
            if t[k] in "([{":
                block = t[k] == "{"
                k = _match(t, k)
                if block and not re.match(r"\s*[.,(\[?]", t[k : k + 80]):
                    return k
                continue
            if t[k] in ",;)]}":
                return k
            if t[k] == "\n" and not re.match(r"\s*(=>|[.?:&|+\-*/,(])", t[k : k + 80]) and not re.search(r"(=>|[=(,?:&|+\-*/])\s*$", t[max(0, k - 80) : k]):
                return k
            k += 1
        return len(t)

    def find_declarations(self) -> None:
        t, found = self.t, []
        for m in _FUNCTION.finditer(t):
            if self.before(m.start()) in ("", ";", "{", "}", ")", "export", "default", "declare", "else"):
                p = t.find("(", m.end())
                end = self.body(_match(t, p)) if p >= 0 else len(t)
                found.append((m.start(), end, m["name"], "function", True, True))
                self.heads.add(m.start("name"))
        for m in _TYPE.finditer(t):
            kw = m["kw"].split()[-1]
            if self.before(m.start()) not in ("", ";", "{", "}", ")", "export", "default", "declare", "abstract", "const") or (kw == "type" and not re.match(r"\s*(<[^=]*>)?\s*=", t[m.end() : m.end() + 400])):
                continue
            o = t.find("{", m.end()) if kw != "type" else -1
            end = (_match(t, o) if o >= 0 else len(t)) if kw != "type" else self.value_end(t.index("=", m.end()) + 1)
            found.append((m.start(), end, m["name"], KIND[kw], kw in ("class", "interface"), False))
        for m in _VALUE.finditer(t):
            arrow = True
            if t[m.end() - 1] == "(":  # an arrow function's parameters, or an expression in brackets
                arrow = bool(re.match(r"\s*(:[^=;{]*(\{[^}]*\})?[^=;{]*)?=>", t[_match(t, m.end() - 1) :][:200]))
            if arrow:
                found.append((m.start("name"), self.value_end(m.start("fn")), m["name"], "function", False, True))
        for m in _METHOD.finditer(t):
            name, p = m["name"], t.index("(", m.end() - 1)
            if name in _WORDS or name == "function" or self.before(m.start()) not in ("{", "}", ";", ",", "*", *_MODIFIERS, ")"):
                continue
            x = _match(t, p)
            near = t[x : x + 400]
            tail = re.match(r"\s*:\s*\{[^}]*\}[^;{}=]*\{", near) or re.match(r"\s*(:\s*[^;{}=\s][^;{}=]*)?\{", near)
            if tail and self.before(m.start()) != ")":
                a = m.start("head") if m["head"] else m.start("name")
                found.append((a, _match(t, x + tail.end() - 1), name, "method", True, True))
                self.heads.add(m.start("name"))
        self.spans = sorted(set(found), key=lambda s: (s[0], -s[1]))
        for s in self.spans:
            a, b, name, kind = s[:4]
            scoped = "::".join([self.root, *self.scope(a, s), name])
            self.symbols.append({"file": self.path, "name": name, "scoped_name": scoped, "kind": kind, "visibility": "private", "attributes": [], "doc_comment": None, "parent": None, "signature": None, **self.place(a, b)})

    def around(self, at: int, but=None) -> list[tuple]:
        return [s for s in self.spans if s[0] <= at < s[1] and s is not but and (but is None or s[:2] != but[:2])]

    def scope(self, at: int, but=None) -> list[str]:
        return [s[2] for s in self.around(at, but) if s[4]]

    def find_calls(self) -> None:
        t = self.t
        for m in _CALL.finditer(t):
            name, a = m["name"], m.start("name") if m["name"] else m.start()
            if name:
                if (name in _WORDS and name not in ("super", "import")) or a in self.heads or (name == "async" and not m["dot"]):
                    continue
                if not m["dot"] and self.before(m.start()) in ("new", "function", "class", "interface"):
                    continue
                method = bool(m["dot"])
            else:
                o = self.open_bracket(m.start())
                if o is None or not re.search(r"[\w$)\]]\s*(\?\.)?\s*$", t[max(0, o - 40) : o]):
                    continue
                text = self.src[o + 1 : m.start()].strip()
                name, method, a = (text[1:-1] if text[:1] in "\"'`" and text[-1:] == text[:1] else text), True, o
            own = self.around(a)
            inner = own[-1] if own else None
            if inner and inner[3] in ("trait", "type", "enum"):
                continue  # signatures
            if inner and inner[3] == "struct" and not method and self.before(m.start()) in ("{", "}", ";", *_MODIFIERS):
                continue  # a method without a body
            fns = [s for s in own if s[5]]
            caller = "::".join([self.root, *self.scope(fns[-1][0], fns[-1]), fns[-1][2]]) if fns else "::".join([self.root, *self.scope(a)])
            self.calls.append({"file": self.path, "caller": caller, "callee_name": name, "is_method_call": method, "start_line": bisect_right(self.lines, a) - 1, "start_byte": self.byte(a)})

    def open_bracket(self, close: int) -> int | None:
        depth = 0
        for k in range(close, -1, -1):
            depth += (self.t[k] in ")]}") - (self.t[k] in "([{")
            if not depth:
                return k if self.t[k] == "[" else None
        return None

    def find_imports(self) -> None:
        for m in _IMPORT.finditer(self.t):
            q = _QUOTE.search(self.src, m.end())
            if not q or not _CLAUSE.fullmatch(self.t[m.end() : q.start()]):
                continue
            e = self.src.find(q.group(), q.end())
            path = self.src[q.end() : e if e >= 0 else len(self.src)]
            clause = self.src[m.end() : q.start()]
            names = [x for x in re.findall(_NAME, clause) if x not in ("type", "from", "as", "require")]
            self.imports.append({"file": self.path, "path": path, "name": names[0] if names else path, "is_glob": "*" in self.src[m.start() : e + 1], "start_line": bisect_right(self.lines, m.start()) - 1})


def parse(path: str, src: str, scope: str | None = None) -> File:
    return File(path, src, scope)
