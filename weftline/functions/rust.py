"""A tolerant item scanner for Rust source: symbols, calls and imports of one file.

Comments, strings and character literals are blanked first, with every position kept, so that braces can
be matched; items are then read scope by scope. Offsets count UTF-8 bytes, rows and columns from 0.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np

_SKIP = re.compile(r"//[^\n]*|/\*|b?r(#*)\"|b?\"|b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.)|[^\\'\n])'", re.S)
_ITEM = re.compile(r"(?P<vis>pub(?:\s*\([^)]*\))?\s+)?(?P<mods>(?:(?:default|async|unsafe|const|extern(?:\s+\" *\")?)\s+)*?)(?P<kw>fn|struct|enum|union|trait|impl|const|static|type|mod|use)\b")
_NAME = re.compile(r"\s*(?:mut\s+)?(?:r#)?([A-Za-z_]\w*)")
_CALL = re.compile(r"(?P<dot>\.\s*)?\b(?P<name>[A-Za-z_]\w*+)\s*+(?P<fish>::\s*<[^()]*?>\s*)?\(")
_MACRO = re.compile(r"\b[A-Za-z_]\w*+!\s*([(\[{])")
_ATTRIBUTE = re.compile(r"#!?\[[^\]]*\]")
_DECLARES = re.compile(r"\b(fn|struct|enum|impl|let|union)$")
_ARM, _ASSIGNS, _LET, _VALUE = re.compile(r"(\||if\b)"), re.compile(r"=[^=]"), re.compile(r"\blet\b[^;{]*$"), re.compile(r"=[^;]*$")
_OTHER, _OPENS = re.compile(r"\w+(!)?"), re.compile(r"\s*([(\[{])")
_SPACES, _NO_LINE_END = re.compile(r"\s"), re.compile(r"[^\n]")
_BRACKET = re.compile(r"[()\[\]{}]")
_WORDS = frozenset("if while for match return loop in let fn move as where impl dyn else unsafe async await mut ref use pub break continue".split())
KIND = {"fn": "function", "struct": "struct", "enum": "enum", "union": "struct", "trait": "trait", "const": "const", "static": "static", "type": "type", "mod": "module"}
_CLOSE = {"(": ")", "[": "]", "{": "}"}


def _blank(s: str) -> str:
    return _NO_LINE_END.sub(" ", s)


def mask(src: str) -> str:
    out, at = [], 0
    while m := _SKIP.search(src, at):
        a, tok = m.start(), m.group()
        if tok == "/*":
            depth, b = 1, m.end()
            while depth and (n := re.compile(r"/\*|\*/").search(src, b)):
                depth, b = depth + (1 if n.group() == "/*" else -1), n.end()
            b = b if not depth else len(src)
        elif tok.startswith(("r", "br")) and tok.endswith('"'):
            end = src.find('"' + (m.group(1) or ""), m.end())
            b = len(src) if end < 0 else end + 1 + len(m.group(1) or "")
        elif tok.endswith('"'):
            n = re.compile(r'(?:[^"\\]|\\.)*"', re.S).match(src, m.end())
            b = n.end() if n else len(src)
        else:
            b = m.end()
        out += [src[at:a], _blank(src[a:b])]
        at = b
    return "".join([*out, src[at:]])


def _match(t: str, at: int) -> int:
    """Place after the bracket that closes the one at `at`."""
    stack = []
    for m in _BRACKET.finditer(t, at):
        ch = m.group()
        if ch in "([{":
            stack.append(_CLOSE[ch])
        else:
            if stack and stack[-1] == ch:
                stack.pop()
            if not stack:
                return m.end()
    return len(t)


def _body(t: str, at: int, end: int) -> tuple[int, int]:
    """(place of the first open brace or semicolon outside of round and square brackets, end of the item)."""
    k = at
    while k < end:
        ch = t[k]
        if ch in "([":
            k = _match(t, k)
            continue
        if ch == "{":
            return k, _match(t, k)
        if ch == ";":
            return k, k + 1
        k += 1
    return end, end


def byte_offsets(src: str):
    """Function from places in a text to offsets in its UTF-8."""
    if src.isascii():
        return int
    at = np.concatenate([[0], np.cumsum((lambda c: 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))(np.frombuffer(src.encode("utf-32-le", "surrogatepass"), np.uint32)))])
    return lambda k: int(at[k])


class File:
    def __init__(self, path: str, src: str):
        self.path, self.src, self.t = path, src, mask(src)
        self.lines = [0, *(m.end() for m in re.finditer("\n", src))]
        self.byte = byte_offsets(src)
        self.symbols: list[dict] = []
        self.calls: list[dict] = []
        self.imports: list[dict] = []
        self.fns: list[tuple[int, int, str]] = []
        self.items(0, len(src), ["crate"], None)
        self.find_calls()

    def place(self, a: int, b: int) -> dict:
        ra, rb = bisect_right(self.lines, a) - 1, bisect_right(self.lines, b) - 1
        return {"start_byte": self.byte(a), "end_byte": self.byte(b), "start_line": ra, "end_line": rb, "start_col": self.byte(a) - self.byte(self.lines[ra]), "end_col": self.byte(b) - self.byte(self.lines[rb])}

    def docs(self, at: int) -> str | None:
        """/// and //! lines right above, attributes skipped."""
        out, k = [], bisect_right(self.lines, at) - 2
        while k >= 0:
            line = self.src[self.lines[k] : self.lines[k + 1]].strip()
            if line.startswith(("///", "//!")):
                out.append(line)
            elif not line.startswith("#["):
                break
            k -= 1
        return "\n".join(reversed(out)) or None

    def add(self, a: int, b: int, name: str, scope: list[str], kind: str, m, attrs, parent=None, signature=None) -> None:
        vis = _SPACES.sub("", m["vis"] or "")
        level = "private" if not vis else "public" if vis == "pub" else "crate" if vis == "pub(crate)" else "super" if vis == "pub(super)" else "restricted"
        scoped = "::".join([*scope, name] if kind != "impl" else [*scope, name])
        self.symbols.append({"file": self.path, "name": name, "scoped_name": scoped, "kind": kind, "visibility": level, "attributes": list(attrs), "doc_comment": self.docs(a), "parent": parent, "signature": signature, **self.place(a, b)})

    def items(self, at: int, end: int, scope: list[str], impl: str | None) -> None:
        t, attrs, first = self.t, [], None
        while at < end:
            if t[at].isspace():
                at += 1
                continue
            if t[at] == "#" and (o := t.find("[", at, at + 3)) >= 0:
                b = _match(t, o)
                attrs.append(self.src[at:b])
                first, at = at if first is None else first, b
                continue
            m = _ITEM.match(t, at, end)
            at = self.item(m, at, end, scope, impl, attrs) if m else self.other(at, end, scope, impl)
            attrs, first = [], None

    def other(self, at: int, end: int, scope: list[str], impl: str | None) -> int:
        """Skips what is no item; blocks are searched for items."""
        t = self.t
        if t[at] == "{":
            b = _match(t, at)
            self.items(at + 1, min(b - 1, end), scope, impl)
            return b
        if t[at] in "([":
            b = _match(t, at)
            self.items(at + 1, min(b - 1, end), scope, impl)
            return b
        m = _OTHER.match(t, at)
        if m and m[1] and (x := _OPENS.match(t, m.end())):
            return _match(t, x.start(1))
        return m.end() if m else at + 1

    def item(self, m, at: int, end: int, scope: list[str], impl: str | None, attrs: list[str]) -> int:
        t, kw = self.t, m["kw"]
        if kw == "use":
            b = t.find(";", m.end(), end)
            b = end if b < 0 else b
            self.use(self.src[m.end() : b], at, b + 1)
            return b + 1
        if kw == "impl":
            o, b = _body(t, m.end(), end)
            head = re.sub(r"^\s*<[^{]*?>\s(?=\s*\w)", " ", t[m.end() : o])
            head = re.split(r"\bwhere\b", head)[0]
            target = re.split(r"\bfor\b", head)[-1]
            n = re.search(r"[A-Za-z_]\w*", re.sub(r"^\s*<[^>]*>", "", target))
            if n:
                self.add(at, b, n.group(), scope, "impl", m, attrs)
            name = n.group() if n else "_"
            self.items(o + 1, b - 1, scope, name)
            return b
        n = _NAME.match(t, m.end(), end)
        if not n:
            return m.end()
        name = n[1]
        if kw in ("const", "static", "type"):
            k = n.end()
            while k < end and t[k] != ";":
                k = _match(t, k) if t[k] in "([{" else k + 1
            own = [*scope, impl] if impl and kw == "const" else scope
            if name != "_":
                self.add(at, k + 1, name, own, KIND[kw], m, attrs, impl if kw == "const" else None)
            return k + 1
        o, b = _body(t, n.end(), end)
        inner = o < end and t[o] == "{"
        if kw == "mod":
            if inner:
                self.add(at, b, name, scope, "module", m, attrs)
                self.items(o + 1, b - 1, [*scope, name], None)
            return b
        if kw == "fn":
            own = [*scope, impl] if impl else scope
            scoped = "::".join([*own, name])
            self.add(at, b, name, own, "method" if impl else "function", m, attrs, impl, self.signature(n.end(), o, m))
            if inner:
                self.fns.append((o, b, scoped))
                self.items(o + 1, b - 1, scope, impl)
            return b
        self.add(at, b, name, scope, KIND[kw], m, attrs)
        if kw == "trait" and inner:
            self.items(o + 1, b - 1, scope, None)
        return b

    def signature(self, at: int, o: int, m) -> dict:
        p = self.t.find("(", at, o)
        q = _match(self.t, p) if p >= 0 else at
        params, depth, last = [], 0, p + 1
        for k in range(p + 1, q):
            ch = self.t[k]
            depth += ch in "([{<"
            depth -= ch in ")]}" or (ch == ">" and self.t[k - 1] != "-")
            if (ch == "," and depth == 0) or k == q - 1:
                if x := self.src[last:k].strip():
                    params.append(x)
                last = k + 1
        rest, _, where = self.src[q:o].partition("where ")
        ret = rest.partition("->")[2].strip() or None
        generics = self.src[at:p].strip() or None
        return {"params": params, "return_type": ret, "is_async": "async" in m["mods"], "is_unsafe": "unsafe" in m["mods"], "is_const": "const" in m["mods"], "generics": generics, "where_clause": where.strip() or None}

    def use(self, tree: str, a: int, b: int) -> None:
        def walk(x: str, prefix: str) -> None:
            x = x.strip()
            if not x:
                return
            if x.endswith("}"):
                head, _, body = x.partition("{")
                depth, last = 0, 0
                body = body[:-1] + ","
                for k, ch in enumerate(body):
                    depth += (ch == "{") - (ch == "}")
                    if ch == "," and not depth:
                        walk(body[last:k], prefix + head.strip())
                        last = k + 1
                return
            path, _, alias = (y.strip() for y in x.partition(" as "))
            full = prefix + path
            name = alias or full.rpartition("::")[2]
            if name == "self":
                full = full.removesuffix("::self")
                name = full.rpartition("::")[2]
            self.imports.append({"file": self.path, "path": full.removesuffix("::*") if path.endswith("*") else full, "name": name, "is_glob": path.endswith("*"), "start_line": bisect_right(self.lines, a) - 1})

        walk(re.sub(r"\s+", " ", tree), "")

    def find_calls(self) -> None:
        t = self.t
        parts, at = [], 0
        for m in _MACRO.finditer(t):
            if m.start(1) >= at:
                b = _match(t, m.start(1))
                parts += [t[at : m.start(1)], _blank(t[m.start(1) : b])]
                at = b
        t = "".join([*parts, t[at:]])
        t = _ATTRIBUTE.sub(lambda m: _blank(m.group()), t)
        fns = sorted(self.fns)
        for m in _CALL.finditer(t):
            name, a = m["name"], m.start("name")
            before = t[max(0, a - 200) : a].rstrip()[-12:]
            if name in _WORDS or _DECLARES.search(before):
                continue
            caller = next((s for o, b, s in reversed(fns) if o < a < b), None)
            end = _match(t, m.end() - 1)
            after = t[end : end + 40].lstrip()
            if after.startswith("=>") or _ARM.match(after) or (_ASSIGNS.match(after) and _LET.search(t[max(0, a - 80) : a])):
                continue
            if caller is None and not _VALUE.search(t[max(0, a - 200) : a]):
                continue  # outside of functions only initialisers call
            fish = re.findall(r"[A-Za-z_]\w*", m["fish"]) if m["fish"] else []
            method = bool(m["dot"]) and not m["fish"]
            self.calls.append({"file": self.path, "caller": caller or "crate::<toplevel>", "callee_name": fish[-1] if fish else name, "is_method_call": method, "start_line": bisect_right(self.lines, a) - 1, "start_byte": self.byte(a)})


def parse(path: str, src: str) -> File:
    return File(path, src)


# -- folding -------------------------------------------------------------------------------------

_KEPT = ("use", "mod", "type", "struct", "enum", "union", "trait")
_SHORT_MACRO = 200


def fold(src: str) -> str:
    """The source reduced to signatures: bodies of functions and values of constants are elided, members of impl blocks
    folded alike, the rest of the items kept with their doc comments and attributes. Each attribute is written once."""
    f = File("", src)
    return "\n".join(_folded(f, 0, len(src), "", False)) + "\n"


def _folded(f: File, at: int, end: int, pad: str, member: bool) -> list[str]:
    t, src, out = f.t, f.src, []
    while at < end:
        if t[at].isspace():
            # comments are blank in the masked text: doc comments outside of impl blocks stay
            line = src[at : (src.find("\n", at) + 1 or len(src)) - 1].strip() if src[at] == "/" else ""
            if line.startswith(("///", "//!")) and not member:
                out.append(pad + line)
            if src.startswith("//", at):
                at = src.find("\n", at) + 1 or end
            elif src.startswith("/*", at):
                at = max(at + 2, src.find("*/", at) + 2 or end)
            else:
                at += 1
            continue
        if t[at] == "#" and (o := t.find("[", at, at + 3)) >= 0:
            b = _match(t, o)
            out.append(pad + src[at:b])
            at = b
            continue
        if x := re.compile(r"extern\s+crate\b[^;]*;").match(t, at, end):
            out.append(pad + src[at : x.end()])
            at = x.end()
            continue
        m = _ITEM.match(t, at, end)
        if m:
            kw, (o, b) = m["kw"], _body(t, m.end(), end)
            if kw in ("const", "static"):
                k = m.end()
                while k < end and t[k] != ";":
                    k = _match(t, k) if t[k] in "([{" else k + 1
                b = k + 1
                head, eq, _ = src[at:b].partition("=")
                out.append(pad + (f"{head.rstrip()} = /* ... */;" if eq else head))
            elif kw == "use":
                b = (t.find(";", m.end(), end) + 1) or end
                out.append(pad + src[at:b])
            elif kw == "fn":
                out.append(pad + src[at:o].rstrip() + (" { /* ... */ }" if o < end and t[o] == "{" else ";"))
            elif kw == "impl":
                out += [pad + src[at:o].rstrip() + " {", *_folded(f, o + 1, b - 1, pad + "    ", True), pad + "}"]
            elif not member or kw == "type":
                if kw == "type" or t[min(o, len(t) - 1)] != "{":
                    b = (t.find(";", m.end(), end) + 1) or end
                out.append(pad + src[at:b])
            at = b
            continue
        x = re.compile(r"[A-Za-z_][\w:]*!\s*[A-Za-z_]*\s*([(\[{])").match(t, at, end)
        if x:
            b = _match(t, x.start(1))
            b += t[b : b + 1] == ";"
            if not member:
                out.append(pad + (src[at:b] if len(src[at:b].encode()) < _SHORT_MACRO else src[at : x.start(1)] + "/* ... */"))
            at = b
            continue
        w = re.compile(r"\w+").match(t, at, end)
        at = _match(t, at) if t[at] in "([{" else w.end() if w else at + 1
    return out


def functions(src: str) -> list[dict]:
    """(name, is_public, signature fields) of the functions of a source text, methods and defaults of traits included, nested ones not."""
    f = File("", src)
    inner = [(f.byte(o), f.byte(b)) for o, b, _ in f.fns]
    own = [s for s in f.symbols if s["kind"] in ("function", "method") and not any(a < s["start_byte"] < b for a, b in inner)]
    return [{"name": s["name"], "is_public": s["visibility"] != "private", **s["signature"]} for s in own]
