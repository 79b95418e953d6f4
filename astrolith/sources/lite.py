"""A small extractor for a subset of C++, in plain Python.

It reads one translation unit (a source file and the includes that it finds) in
one pass and emits tagged rows in visit order.  Covered: namespaces, classes,
structs, unions, bases, fields, methods, free functions, parameters, enums,
global and local variables, calls by name, string literals.  Not covered, as
documented defaults and never guessed: overload resolution (a call takes the
first callable of that name and, if any, that argument count), field offsets
(-1), virtual-ness inherited without the keyword, macros, templates (their
declarations are skipped, as the fact model wants).  USRs are synthetic:
``kind:qualified(parameter types)``.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<string>(?:u8|u|U|L)?"(?:\\.|[^"\\\n])*")|(?P<char>(?:u8|u|U|L)?'(?:\\.|[^'\\\n])+')|(?P<number>\.?\d(?:[\w.']|[eEpP][+-])*)"""
    r"""|(?P<word>[A-Za-z_]\w*)|(?P<op>::|->\*?|\+\+|--|<<=?|[-+*/%&|^!=]=|&&|\|\||\.\.\.|[^\s\w])""")
_COMMENT = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])+'""", re.S)
_INCLUDE = re.compile(r'^[ \t]*#[ \t]*include[ \t]*["<]([^">]+)[">]', re.M)
_QUALIFIERS = {"const", "volatile", "static", "extern", "inline", "virtual", "explicit", "constexpr", "friend", "mutable", "register", "typename",
               "unsigned", "signed", "long", "short", "thread_local", "struct", "class", "enum", "union", "consteval", "constinit"}
_NOT_CALLED = {"if", "while", "for", "switch", "return", "sizeof", "catch", "alignof", "decltype", "static_assert", "defined", "new", "delete", "throw",
               "static_cast", "dynamic_cast", "reinterpret_cast", "const_cast", "noexcept", "operator", "alignas", "typeid"}
_BASIC = {"void", "bool", "char", "int", "float", "double", "auto", "wchar_t", "size_t", "unsigned", "signed", "long", "short", "char8_t", "char16_t", "char32_t"}


@dataclass
class Token:
    kind: str
    text: str
    file: str
    line: int
    column: int
    end: int


@dataclass
class Callable_:
    usr: str
    name: str
    n_params: tuple[int, int]
    is_virtual: bool
    is_method: bool


@dataclass
class Unit:
    """State of one translation unit and the rows it emits."""

    path: str
    args: list[str]
    rows: list[tuple[str, dict]] = field(default_factory=list)
    ids: dict[tuple[str, str], int] = field(default_factory=dict)
    files: dict[str, int] = field(default_factory=dict)
    callables: dict[str, list[Callable_]] = field(default_factory=dict)
    bodies: list[tuple] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)

    def id_of(self, kind: str, usr: str) -> int:
        key = (kind, usr)
        if key not in self.ids:
            self.ids[key] = self.next(f"id of {kind}")
        return self.ids[key]

    def file_id(self, path: str) -> int:
        return self.files.setdefault(path, len(self.files) + 1)

    def emit(self, table: str, **row) -> None:
        self.rows.append((table, row))

    def next(self, table: str) -> int:
        self.counts[table] = self.counts.get(table, 0) + 1
        return self.counts[table]


def _without_comments(text: str) -> str:
    keep = lambda m: m[0] if m[0][0] in "\"'" else re.sub(r"[^\n]", " ", m[0])
    return _COMMENT.sub(keep, text)


def _resolve(name: str, folder: str, args: list[str]) -> str | None:
    dirs = [folder]
    for i, a in enumerate(args):
        if a.startswith("-I"):
            dirs.append(a[2:] or (args[i + 1] if i + 1 < len(args) else ""))
        elif a == "-isystem" and i + 1 < len(args):
            dirs.append(args[i + 1])
    for d in dirs:
        p = os.path.normpath(os.path.join(d, name))
        if os.path.isfile(p):
            return p
    return None


def _lines(path: str, text: str | None = None) -> str:
    if text is None:
        with open(path, encoding="utf-8", errors="replace") as f:
            text = f.read()
    text = _without_comments(text.replace("\r\n", "\n"))
    # blocks under #if 0 are no code; continued directives are one line
    text = re.sub(r"^[ \t]*#[ \t]*if[ \t]+0\b.*?^[ \t]*#[ \t]*endif[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S | re.M)
    return re.sub(r"^[ \t]*#(?![ \t]*include)(?:[^\n\\]|\\.|\\\n)*", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.M)


def inclusions(path: str, args: list[str]) -> list[str]:
    """Files that the source includes, directly or not, in first-seen order."""
    seen: list[str] = []

    def visit(p: str) -> None:
        for m in _INCLUDE.finditer(_lines(p)):
            q = _resolve(m[1], os.path.dirname(p), args)
            if q and q not in seen and q != path:
                seen.append(q)
                visit(q)

    visit(path)
    return seen


def _tokens(path: str, args: list[str], done: set[str], text: str | None = None) -> list[Token]:
    done.add(path)
    out: list[Token] = []
    for n, line in enumerate(_lines(path, text).split("\n"), 1):
        m = _INCLUDE.match(line)
        if m:
            q = _resolve(m[1], os.path.dirname(path), args)
            if q and q not in done:
                out += _tokens(q, args, done)
            continue
        if line.lstrip().startswith("#"):
            continue
        out += [Token(t.lastgroup, t[0], path, n, t.start() + 1, t.end()) for t in _TOKEN.finditer(line)]
    return out


def extract(path: str, args: list[str] = (), text: str | None = None) -> list[tuple[str, dict]]:
    """(table, row) of one translation unit, in visit order; ``text`` stands for the file's contents."""
    unit = Unit(path, list(args))
    unit.file_id(path)
    tokens = _tokens(path, unit.args, set(), text)
    for t in tokens:
        unit.file_id(t.file)
    for p, i in unit.files.items():
        unit.emit("files", id=i, path=p, is_main_file=int(p == path), mtime=0, is_header=int(".h" in p), is_system=0)
    _Parser(unit, tokens).scope(0, len(tokens), [], None, "public")
    for body in unit.bodies:
        _calls(unit, *body)
    return unit.rows


def _spelled(tokens: list[Token]) -> str:
    s = " ".join(t.text for t in tokens)
    for a, b in ((" :: ", "::"), (":: ", "::"), (" ::", "::"), (" <", "<"), ("< ", "<"), (" >", ">"), (" ,", ","), (" (", "("), ("( ", "("), (" )", ")"), (" [", "["), ("[ ", "["), (" ]", "]")):
        s = s.replace(a, b)
    return s


class _Parser:
    def __init__(self, unit: Unit, tokens: list[Token]):
        self.u, self.t = unit, tokens

    def close(self, i: int, end: int) -> int:
        pairs = {"(": ")", "{": "}", "[": "]"}
        a, b, depth = self.t[i].text, pairs[self.t[i].text], 0
        for j in range(i, end):
            depth += (self.t[j].text == a) - (self.t[j].text == b)
            if depth == 0:
                return j
        return end - 1

    def angle(self, i: int, end: int) -> int:
        depth = 0
        for j in range(i, end):
            x = self.t[j].text
            depth += (x == "<") - (x == ">") - 2 * (x == ">>")
            if depth <= 0:
                return j
            if x in ";{":
                return i
        return i

    # -- declarations ---------------------------------------------------------

    def scope(self, i: int, end: int, names: list[str], cls: str | None, access: str) -> None:
        t = self.t
        while i < end:
            x = t[i].text
            if x in (";", "}"):
                i += 1
            elif x in ("public", "protected", "private") and i + 1 < end and t[i + 1].text == ":":
                access = x
                i += 2
            elif x == "template":
                i = self.skip(self.angle(i + 1, end) + 1, end)
            elif x in ("using", "typedef", "friend", "static_assert"):
                i = self.skip(i, end)
            elif x == "extern" and i + 2 < end and t[i + 1].kind == "string" and t[i + 2].text == "{":
                stop = self.close(i + 2, end)
                self.scope(i + 3, stop, names, cls, access)
                i = stop + 1
            elif x == "namespace" or x == "inline" and i + 1 < end and t[i + 1].text == "namespace":
                j = i
                inner = []
                while j < end and t[j].text not in "{;=":
                    if t[j].kind == "word" and t[j].text not in ("namespace", "inline"):
                        inner.append(t[j].text)
                    j += 1
                if j < end and t[j].text == "{":
                    stop = self.close(j, end)
                    self.scope(j + 1, stop, [*names, *inner], None, "public")
                    i = stop + 1
                else:
                    i = self.skip(j, end)
            elif x in ("class", "struct", "union") and self.is_record(i, end):
                i = self.record(i, end, names, cls, access)
            elif x == "enum":
                i = self.enum(i, end, names)
            else:
                i = self.declaration(i, end, names, cls, access)

    def skip(self, i: int, end: int) -> int:
        while i < end:
            x = self.t[i].text
            if x == ";":
                return i + 1
            if x in "({[":
                j = self.close(i, end)
                if x == "{" and not (j + 1 < end and self.t[j + 1].text in (";", ",", ")")):
                    return j + 1
                i = j
            i += 1
        return end

    def is_record(self, i: int, end: int) -> bool:
        for j in range(i + 1, end):
            x = self.t[j].text
            if x in "{;":
                return True
            if x in "()=*&,":
                return False
        return False

    def record(self, i: int, end: int, names: list[str], outer: str | None, outer_access: str) -> int:
        t, u = self.t, self.u
        kind, j = t[i].text, i + 1
        while j < end and t[j].kind != "word" and t[j].text not in "{;:":
            j += 1
        name = t[j].text if j < end and t[j].kind == "word" else ""
        at = t[j] if name else t[i]
        stop = j
        while stop < end and t[stop].text not in "{;":
            if t[stop].text == "<":
                stop = max(stop, self.angle(stop, end))
            stop += 1
        if stop >= end:
            return end
        if t[stop].text == ";" and any(x.kind == "word" and x.text != "final" for x in t[j + 1 : stop]):
            return self.declaration(i, end, names, outer, outer_access)
        qualified = "::".join([*names, name]) if name else "::".join(names)
        usr = f"class:{qualified}" if name else f"class:{qualified}@{at.file}:{at.line}"
        cid = u.id_of("classes", usr)
        defined = t[stop].text == "{"
        body_end = self.close(stop, end) if defined else stop
        abstract = int(defined and any(t[k].text == "=" and t[k + 1].text == "0" and t[k + 2].text == ";" and t[k - 1].text in (")", "const", "noexcept", "override", "final")
                                       for k in range(stop, max(stop, body_end - 2))))
        u.emit("classes", id=cid, usr=usr, name=name, qualified_name=qualified, kind=kind, file_id=u.file_id(at.file), line=at.line,
               is_definition=int(defined), is_abstract=abstract, namespace_id=0, is_system=0)
        if defined:
            colon = next((k for k in range(j, stop) if t[k].text == ":"), None)
            if colon and kind != "union":
                self.bases(colon + 1, stop, usr, name, names, kind, at)
            self.scope(stop + 1, body_end, [*names, name] if name else names, usr, "private" if kind == "class" else "public")
            return body_end + 1
        return stop + 1

    def bases(self, i: int, stop: int, usr: str, name: str, names: list[str], kind: str, at: Token) -> None:
        u, part = self.u, []
        depth = 0
        for k in range(i, stop + 1):
            x = self.t[k].text if k < stop else ","
            depth += (x == "<") - (x == ">")
            if x == "," and depth == 0:
                words = [p.text for p in part]
                access = next((w for w in words if w in ("public", "protected", "private")), "private" if kind == "class" else "public")
                base = "".join(w for w in words if w not in ("public", "protected", "private", "virtual"))
                if base:
                    u.emit("inheritance", id=u.next("inheritance"), derived_usr=usr, derived_name=name, base_usr=self.class_usr(base, names), base_name=base,
                           access=access, file_id=u.file_id(at.file), is_virtual=int("virtual" in words), is_system=0)
                part = []
            elif k < stop:
                part.append(self.t[k])

    def class_usr(self, base: str, names: list[str]) -> str:
        for n in range(len(names), -1, -1):
            usr = "class:" + "::".join([*names[:n], base])
            if ("classes", usr) in self.u.ids:
                return usr
        return "class:" + base

    def enum(self, i: int, end: int, names: list[str]) -> int:
        t, u = self.t, self.u
        j, scoped = i + 1, 0
        if j < end and t[j].text in ("class", "struct"):
            scoped, j = 1, j + 1
        name = t[j].text if j < end and t[j].kind == "word" else ""
        at = t[j] if name else t[i]
        stop = j
        while stop < end and t[stop].text not in "{;":
            stop += 1
        if stop >= end:
            return end
        colon = next((k for k in range(j, stop) if t[k].text == ":"), None)
        under = _spelled(t[colon + 1 : stop]) if colon else ("int" if scoped else "unsigned int")
        qualified = "::".join([*names, name]) if name else "::".join(names)
        usr = f"enum:{qualified}" if name else f"enum:{qualified}@{at.file}:{at.line}"
        eid = u.id_of("enums", usr)
        u.emit("enums", id=eid, usr=usr, name=name, underlying_type=under, is_scoped=scoped, file_id=u.file_id(at.file), line=at.line, is_system=0)
        if t[stop].text == ";":
            return stop + 1
        body_end, value, k = self.close(stop, end), -1, stop + 1
        while k < body_end:
            if t[k].kind == "word":
                value += 1
                label = t[k].text
                k += 1
                if k < body_end and t[k].text == "=":
                    given = []
                    k += 1
                    while k < body_end and t[k].text != ",":
                        given.append(t[k].text)
                        k += 1
                    try:
                        value = int("".join(given).rstrip("uUlL"), 0)
                    except ValueError:
                        pass
                u.emit("enum_values", id=u.next("enum_values"), enum_id=eid, name=label, value=value, is_system=0)
            k += 1
        return self.skip(body_end + 1, end) if body_end + 1 < end else end

    def declaration(self, i: int, end: int, names: list[str], cls: str | None, access: str) -> int:
        """One function, method, field or variable declaration."""
        t = self.t
        j, paren = i, None
        while j < end:
            x = t[j].text
            if x == "<" and j > i and t[j - 1].kind == "word":
                j = max(j, self.angle(j, end))
            elif x == "operator" and cls is not None or x == "operator":
                k = j + 1
                while k < end and t[k].text != "(" or (k < end and t[k].text == "(" and k == j + 1 and t[k + 1].text == ")" and t[k + 2].text == "("):
                    k += 1
                paren = k if paren is None else paren
                j = self.close(k, end) if k < end else end
            elif x == "(" and paren is None and j + 3 < end and t[j + 1].text == "*" and t[j + 2].kind == "word" and t[j + 3].text == ")":
                return self.pointer(i, j, end, names, cls, access)
            elif x == "(":
                if paren is None and j > i and (t[j - 1].kind == "word" and t[j - 1].text not in _QUALIFIERS):
                    paren = j
                j = self.close(j, end)
            elif x in (";", "{", "="):
                break
            elif x == ":" and paren is not None:
                break
            elif x == "}":
                return j
            j += 1
        if j >= end:
            return end
        if paren is not None and self.is_function(i, paren, j, end):
            return self.function(i, paren, j, end, names, cls, access)
        stop = self.skip(j, end) if t[j].text != "{" else self.skip(self.close(j, end), end)
        self.variables(i, stop, names, cls, access)
        return stop

    def pointer(self, i: int, j: int, end: int, names: list[str], cls: str | None, access: str) -> int:
        """A field or variable that points to a function: ``R (*name)(..);``"""
        t, u = self.t, self.u
        stop = self.skip(j, end)
        args = self.close(j + 4, end) if j + 4 < end and t[j + 4].text == "(" else j + 3
        at = t[j + 2]
        kind = [*[x for x in t[i:j] if x.text not in ("static", "extern")], t[j], t[j + 1], *t[j + 3 : args + 1]]
        if cls and t[i].text != "static":
            u.emit("fields", id=u.next("fields"), class_id=u.id_of("classes", cls), name=at.text, type=_spelled(kind), access=access, is_static=0,
                   is_mutable=0, bit_width=-1, offset_bits=-1, is_system=0)
        else:
            self.variable(at, kind, {t[i].text}, "::".join([*names, at.text]), "global", dict(function_id=0, method_id=0))
        return stop

    def is_function(self, i: int, paren: int, j: int, end: int) -> bool:
        """A declarator's parentheses hold parameters, not a value."""
        inner = self.t[paren + 1 : self.close(paren, end)]
        if not inner:
            return True
        if self.t[j].text == "{" or self.t[paren - 1].text.startswith("operator"):
            return True
        first = inner[0]
        if first.kind in ("number", "string", "char") or first.text in ("&", "-", "true", "false", "nullptr", "{", "!"):
            return False
        return len(inner) > 1 or first.text in _BASIC or first.text == "..." or self.t[i].text == "virtual"

    def parameters(self, paren: int, end: int) -> list[list[Token]]:
        stop, out, depth = self.close(paren, end), [[]], 0
        for k in range(paren + 1, stop):
            x = self.t[k].text
            depth += (x in "([{<") - (x in ")]}>")
            if x == "," and depth == 0:
                out.append([])
            else:
                out[-1].append(self.t[k])
        return [p for p in out if p and [x.text for x in p] != ["void"]]

    def function(self, i: int, paren: int, j: int, end: int, names: list[str], cls: str | None, access: str) -> int:
        t, u = self.t, self.u
        # the name: words before the parenthesis, with its scope
        k = paren - 1
        op = next((m for m in range(i, paren) if t[m].text == "operator"), None)
        if op is not None:
            name, k = "operator" + "".join(x.text for x in t[op + 1 : paren]), op
        else:
            name = t[k].text
            if k > i and t[k - 1].text == "~":
                name, k = "~" + name, k - 1
        at = t[k]
        scope: list[str] = []
        while k - 2 >= i and t[k - 1].text == "::" and t[k - 2].kind == "word":
            scope.insert(0, t[k - 2].text)
            k -= 2
        head = t[i:k]
        words = {x.text for x in head}
        params = self.parameters(paren, end)
        variadic = bool(params) and params[-1][-1].text == "..." and len(params[-1]) == 1
        if variadic:
            params = params[:-1]
        tail = [x.text for x in t[self.close(paren, end) + 1 : j]]
        owner = cls or (self.class_usr("::".join(scope), names) if scope and ("classes", self.class_usr("::".join(scope), names)) in u.ids else None)
        full = [*names, *scope] if cls is None else names
        qualified = "::".join([*(owner[6:].split("::") if owner else full), name])
        types = ",".join(_spelled(self.type_of(p)) for p in params) + (",..." if variadic else "")
        usr = f"{'method' if owner else 'function'}:{qualified}({types}){' const' if 'const' in tail else ''}"
        returns = _spelled([x for x in head if x.text not in ("static", "inline", "virtual", "explicit", "extern", "constexpr", "friend")])
        # where the declaration ends
        m = j
        pure = 0
        if t[m].text == "=":
            pure = int(m + 1 < end and t[m + 1].text == "0")
            while m < end and t[m].text != ";":
                m += 1
        if m < end and t[m].text == ":":
            while m < end and t[m].text != "{":
                m = self.close(m, end) if t[m].text == "(" else m
                m += 1
            # braces that initialise members precede the body
            while m < end and self.close(m, end) + 1 < end and t[self.close(m, end) + 1].text in (",", "{"):
                n = self.close(m, end) + 1
                while n < end and t[n].text != "{":
                    n = self.close(n, end) if t[n].text == "(" else n
                    n += 1
                m = n
        defined = m < end and t[m].text == "{"
        last = self.close(m, end) if defined else m
        last = min(last, end - 1)
        close = t[last] if defined else t[last - 1]
        place = dict(line=at.line, column=at.column, end_line=close.line, end_column=close.end + 1)
        is_virtual = int("virtual" in words or "override" in tail or "final" in tail)
        if owner:
            fid = u.id_of("methods", usr)
            u.emit("methods", id=fid, usr=usr, class_id=u.id_of("classes", owner), name=name, qualified_name=qualified, return_type=returns,
                   access=access if cls else "public", is_virtual=is_virtual, is_pure_virtual=pure, is_static=int("static" in words),
                   is_const=int("const" in tail), is_override=0, is_final=0, **place, is_system=0)
        else:
            fid = u.id_of("functions", usr)
            u.emit("functions", id=fid, usr=usr, name=name, qualified_name=qualified, return_type=returns, file_id=u.file_id(at.file), **place,
                   is_definition=int(defined), is_inline=int("inline" in words), is_variadic=int(variadic), is_static=int("static" in words), is_system=0)
        keys = dict(function_id=0 if owner else fid, method_id=fid if owner else 0)
        fewest = 0
        for n, p in enumerate(params):
            default = next((q for q, x in enumerate(p) if x.text == "="), None)
            fewest += default is None
            decl = p[:default] if default is not None else p
            label = decl[-1].text if len(decl) > 1 and decl[-1].kind == "word" and decl[-1].text not in _BASIC | _QUALIFIERS and decl[-2].text != "::" else ""
            u.emit("parameters", id=u.next("parameters"), **keys, name=label, type=_spelled(self.type_of(p)), index_=n, has_default=int(default is not None), is_system=0)
        u.callables.setdefault(name, []).append(Callable_(usr, name, (fewest, 99 if variadic else len(params)), bool(is_virtual), bool(owner)))
        if defined:
            body = t[m + 1 : last]
            u.bodies.append((usr, self.t[self.close(paren, end) + 1 : m] + body))
            self.locals(m + 1, last, keys)
            for x in body:
                if x.kind == "string":
                    self.literal(x, usr, keys)
            return last + 1
        return m + 1

    def type_of(self, p: list[Token]) -> list[Token]:
        default = next((q for q, x in enumerate(p) if x.text == "="), None)
        decl = p[:default] if default is not None else p
        if len(decl) > 1 and decl[-1].kind == "word" and decl[-1].text not in _BASIC | _QUALIFIERS and decl[-2].text != "::":
            return decl[:-1]
        return decl

    def literal(self, x: Token, usr: str, keys: dict) -> None:
        u = self.u
        a, b = x.text.index('"'), x.text.rindex('"')
        u.emit("string_literals", id=u.next("string_literals"), content=x.text[a + 1 : b], file_id=u.file_id(x.file), line=x.line, column=x.column,
               function_usr=usr, func_id=keys["function_id"], method_id=keys["method_id"], is_wide=int(x.text.startswith("L")), is_system=0)

    def declarators(self, i: int, stop: int):
        """(type tokens, name token) of ``type a = .., *b, c[3];``"""
        t = self.t
        j, depth = i, 0
        while j < stop and t[j].text not in ("=", ";", "{", "[", ",", "(", ":"):
            if t[j].text == "<":
                j = max(j, self.angle(j, stop))
            j += 1
        if j - 1 <= i or t[j - 1].kind != "word" or t[j - 1].text in _BASIC | _QUALIFIERS or t[j - 2].text == "::":
            return
        kind = t[i : j - 1]
        yield kind, t[j - 1]
        base = [x for x in kind if x.text not in ("*", "&")]
        while j < stop:
            x = t[j].text
            if x in "({[":
                j = self.close(j, stop)
            elif x == "<" and t[j - 1].kind == "word":
                j = max(j, self.angle(j, stop))
            elif x == "," and depth == 0:
                stars = []
                while j + 1 < stop and t[j + 1].text in ("*", "&"):
                    j += 1
                    stars.append(t[j])
                if j + 1 < stop and t[j + 1].kind == "word":
                    yield [*base, *stars], t[j + 1]
                    j += 1
            j += 1

    def variables(self, i: int, stop: int, names: list[str], cls: str | None, access: str) -> None:
        t, u = self.t, self.u
        words = {x.text for x in t[i:stop]}
        lead = {x.text for x in t[i : i + 4]}
        for kind, at in self.declarators(i, stop):
            clean = [x for x in kind if x.text not in ("static", "extern", "mutable", "inline", "constexpr", "register", "thread_local")]
            if not clean:
                continue
            if cls and "static" not in lead:
                colon = next((k for k in range(i, stop) if t[k].text == ":" and t[k - 1] is at), None)
                width = int(t[colon + 1].text) if colon and t[colon + 1].text.isdigit() else -1
                u.emit("fields", id=u.next("fields"), class_id=u.id_of("classes", cls), name=at.text, type=_spelled(clean), access=access, is_static=0,
                       is_mutable=int("mutable" in words), bit_width=width, offset_bits=-1, is_system=0)
            else:
                self.variable(at, clean, lead, "::".join([*names, at.text]), "global", dict(function_id=0, method_id=0))
        for x in t[i:stop]:
            if x.kind == "string" and not cls:
                self.literal(x, "", dict(function_id=0, method_id=0))

    def variable(self, at: Token, kind: list[Token], lead: set[str], qualified: str, scope: str, keys: dict) -> None:
        u = self.u
        storage = next((s for s in ("static", "extern", "register") if s in lead), "none")
        usr = f"variable:{qualified}" + ("" if scope == "global" else f"@{at.line}")
        u.emit("variables", id=u.next("variables"), usr=usr, name=at.text, type=_spelled(kind), file_id=u.file_id(at.file), line=at.line, **keys, namespace_id=0,
               scope_kind=scope, storage_class=storage, is_const=int("const" in {x.text for x in kind}), is_inline=0, is_system=0)

    def locals(self, i: int, stop: int, keys: dict) -> None:
        """Local variables: declarations at the start of statements."""
        t = self.t
        start = True
        j = i
        while j < stop:
            x = t[j].text
            if start and t[j].kind == "word" and x not in ("return", "delete", "throw", "using", "goto", "case", "else", "typedef", "if", "while", "switch", "do", "new"):
                end = j
                while end < stop and t[end].text not in (";", "{", "}"):
                    end = self.close(end, stop) if t[end].text in "([" else end
                    end += 1
                head = []
                k = j
                while k < end and (t[k].kind == "word" or t[k].text in ("::", "*", "&", "&&")):
                    head.append(t[k])
                    k += 1
                    if k < end and t[k].text == "<":
                        k = max(k, self.angle(k, end)) + 1
                words = [h for h in head if h.kind == "word"]
                follows = t[k].text if k < stop else ";"
                typed = len(words) >= 2 and head[-1].kind == "word" and (head[-2].text != "::")
                if typed and follows in ("=", ";", "(", "{", "[", ",", ":") and not (follows == "(" and words[-2].text in _NOT_CALLED):
                    lead = {h.text for h in head}
                    kind = [h for h in t[j : k - 1] if h.text not in ("static", "register", "constexpr", "thread_local")]
                    self.variable(head[-1], kind, lead, head[-1].text, "static_local" if "static" in lead else "local", keys)
            start = x in (";", "{", "}") or (x == "(" and j > i and t[j - 1].text == "for")
            j += 1


def _calls(u: Unit, usr: str, body: list[Token]) -> None:
    for i, x in enumerate(body[:-1]):
        if x.kind != "word" or body[i + 1].text not in ("(", "{") or x.text in _NOT_CALLED:
            continue
        known = u.callables.get(x.text)
        if not known or (body[i + 1].text == "{" and not any(k.usr.startswith("method:") for k in known)):
            continue
        depth = n = 0
        for y in body[i + 1 :]:
            depth += (y.text in "({[") - (y.text in ")}]")
            n += depth == 1 and y.text == ","
            if depth == 0:
                break
        n = n + 1 if body[i + 2].text not in (")", "}") else 0
        member = i > 0 and body[i - 1].text in (".", "->")
        pool = [k for k in known if k.is_method] if member else known
        pool = pool or known
        best = next((k for k in pool if k.n_params[0] <= n <= k.n_params[1]), pool[0])
        u.emit("calls", id=u.next("calls"), caller_usr=usr, callee_usr=best.usr, callee_name=x.text, file_id=u.file_id(x.file), line=x.line, column=x.column,
               is_virtual=int(best.is_virtual and member), is_system=0)
