"""TypeScript and JavaScript text as tokens, and the declarations and calls that one pass over them finds.

The tokeniser keeps the state that lines can't: nested brackets, template literals with code in them, and
whether a slash divides or begins a pattern. Declarations may then be spread over any number of lines.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from operator import add
from typing import NamedTuple

TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^\\`$])*(`|\$\{|\Z)", re.S)
PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
SIGNS = re.compile(r"=>|\.\.\.|\?\.(?!\d)|[-+*/%=!&|^<>?]?=|&&|\|\||\?\?|.", re.S)
#: places behind the last token that may be asked for
AHEAD = 64
PAIRS = {"(": ")", "[": "]", "{": "}", "${": "}"}

#: fixed values: words before a bracket that are no call, and words after which a slash begins a pattern
NO_CALL = frozenset("if for while switch catch return function typeof new await super constructor import of in do else case throw delete void yield instanceof with class extends implements as is keyof async get set".split())
BEFORE_PATTERN = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())
MODIFIERS = frozenset("public private protected static async readonly override abstract get set declare accessor".split())


class Token(NamedTuple):
    kind: str  # word, value, sign
    text: str
    start: int
    end: int


#: what stands behind white space at a place of a text; what a slash begins depends on the token before it
PIECE = re.compile(
    r"\s*+(?:(?P<word>[#@]?[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<value>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|\d[\w.]*)"
    r"|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<quote>`)|(?P<slash>/)|(?P<sign>[<>]|=>|\.\.\.|\?\.(?!\d)|[-+*%=!&|^?]?=|&&|\|\||\?\?|.)|\Z)",
    re.S,
)
WORD, OPEN, CLOSE, VALUE, COMMENT, QUOTE, SLASH, SIGN = (PIECE.groupindex[k] for k in "word open close value comment quote slash sign".split())
KINDS = {WORD: "word", VALUE: "value", SIGN: "sign"}


class Tokens:
    """The tokens of a text by columns, since most are looked at once or never; a Token is made when one is asked for."""

    def __init__(self) -> None:
        self.kinds: list[int] = []
        self.texts: list[str] = []
        self.starts: list[int] = []
        self.ends: list[int] = []

    def __len__(self) -> int:
        return len(self.kinds)

    def __getitem__(self, i: int) -> Token:
        return Token(KINDS[self.kinds[i]], self.texts[i], self.starts[i], self.ends[i])


def tokenise(text: str) -> tuple[Tokens, dict[int, tuple[int, int]], list[int]]:
    """Tokens, the last comment (start, end) before a token, and each bracket's partner (or the number of tokens)."""
    tokens = Tokens()
    kinds, texts, starts = tokens.kinds, tokens.texts, tokens.starts
    kind, put, start = kinds.append, texts.append, starts.append
    notes: dict[int, tuple[int, int]] = {}
    partner: dict[int, int] = {}
    # ends of tokens whose text is not what stands there
    ends: dict[int, int] = {}
    stack: list[int] = []

    def template(begin: int, inside: int) -> int:
        """A piece of a template literal up to its end or to code in it; gives what follows it."""
        m = TEMPLATE.match(text, inside)
        ends[len(kinds)] = m.end()
        kind(VALUE)
        put("`")
        start(begin)
        if m[1] == "${":
            stack.append(len(kinds))
            ends[len(kinds)] = m.end()
            kind(SIGN)
            put("${")
            start(m.end())
        return m.end()

    at: int | None = 0
    while at is not None:
        # the scan begins anew behind what PIECE alone can't read: templates and patterns
        pieces, at = PIECE.finditer(text, at), None
        for m in pieces:
            what = m.lastindex
            if what == WORD or what == SIGN or what == VALUE:
                kind(what)
                put(m[what])
                start(m.start(what))
            elif what == OPEN:
                stack.append(len(kinds))
                kind(SIGN)
                put(m[what])
                start(m.start(what))
            elif what == CLOSE:
                c, opened = m[what], None
                # brackets that were never closed give way to one that is
                while stack:
                    opened = stack.pop()
                    if PAIRS[texts[opened]] == c:
                        break
                    opened = None
                if opened is not None:
                    partner[opened], partner[len(kinds)] = len(kinds), opened
                kind(SIGN)
                put(c)
                start(m.start(what))
                if opened is not None and texts[opened] == "${":
                    at = template(m.end(), m.end())
                    break
            elif what is None:
                break
            elif what == COMMENT:
                notes[len(kinds)] = m.span(what)
            elif what == QUOTE:
                at = template(m.start(what), m.end())
                break
            else:
                begin = m.start(what)
                found = begins_pattern(tokens) and PATTERN.match(text, begin)
                kind(VALUE if found else SIGN)
                found = found or SIGNS.match(text, begin)
                put(found[0])
                start(begin)
                at = found.end()
                break
    n = len(kinds)
    tokens.ends = list(map(add, starts, map(len, texts)))
    for i, end in ends.items():
        tokens.ends[i] = end
    partners = [n] * n
    for i, j in partner.items():
        partners[i] = j
    return tokens, notes, partners


def begins_pattern(tokens: Tokens) -> bool:
    if not len(tokens):
        return True
    last, text = tokens.kinds[-1], tokens.texts[-1]
    return text in BEFORE_PATTERN if last == WORD else last == SIGN and text not in (")", "]", "}")


class Reader:
    """Symbols, imports and calls of one file as rows."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.tokens, self.notes, self.partner = tokenise(text)
        self.kinds, self.texts, self.starts, self.ends = self.tokens.kinds, self.tokens.texts, self.tokens.starts, self.tokens.ends
        # texts of words and signs; none for values, nor where one looks a little before the first or behind the last
        self.seen = ["" if k == VALUE else t for k, t in zip(self.kinds, self.texts, strict=True)] + [""] * AHEAD
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.symbols: list[dict] = []
        self.imports: list[dict] = []
        self.calls: list[dict] = []
        # spans that wait to be read: (first token, behind the last, caller); a stack, so depth is no limit
        self.waiting: list[tuple[int, int, str | None]] = [(0, len(self.kinds), None)]
        while self.waiting:
            self.read(*self.waiting.pop())

    # --- small helpers on tokens ---

    def is_(self, i: int, *texts: str) -> bool:
        return self.seen[i] in texts

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.kinds) and self.kinds[i] == WORD

    def place(self, offset: int) -> tuple[int, int]:
        """1-based line and column."""
        line = bisect_right(self.breaks, offset - 1)
        return line + 1, offset - (self.breaks[line - 1] if line else -1)

    def new_line(self, i: int) -> bool:
        """Whether token i begins on a later line than the one before it ends."""
        return i > 0 and "\n" in self.text[self.ends[i - 1] : self.starts[i]]

    def source(self, first: int, behind: int) -> str:
        """The text of tokens first to behind - 1, without comments."""
        if first >= behind:
            return ""
        text = self.text[self.starts[first] : self.ends[behind - 1]]
        if "/" in text:
            text = COMMENT_OR_TEXT.sub(lambda m: m[1] or " ", text)
        return " ".join(text.split())

    def angles(self, i: int) -> int:
        """Behind the '>' that closes the '<' at i; i itself if it closes nothing."""
        if not self.is_(i, "<"):
            return i
        depth, j = 0, i
        while j < len(self.kinds):
            t = self.seen[j]
            if t in PAIRS:
                j = self.partner[j]
            elif t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif t in (";", ")", "]", "}", "&&", "||", "+", "-", "*", "/"):
                return i
            j += 1
        return i

    def type_end(self, i: int, *stops: str) -> int:
        """Behind the type at i: at the first of ``stops`` outside brackets that doesn't belong to the type."""
        j, fresh = i, True
        while j < len(self.kinds):
            t = self.seen[j]
            if t in stops and not (fresh and t == "{"):
                return j
            if t in (")", "]", "}", ";"):
                return j
            if not fresh and t not in ("|", "&", "[", "=>", ".", "<", ">") and self.new_line(j):
                return j
            fresh = t in ("|", "&", ":", "=>", ",", "keyof", "typeof", "readonly", "is")
            j = k if t == "<" and (k := self.angles(j)) > j else self.partner[j] + 1 if t in PAIRS else j + 1
        return j

    def heritage(self, i: int, end: int) -> list[str]:
        """Expressions behind extends and implements, without type arguments."""
        bases, first, j = [], None, i
        while j <= end:
            over = j == end or self.is_(j, ",", "extends", "implements")
            if over and first is not None:
                bases.append(self.source(first, j))
                first = None
            if self.is_(j, "extends", "implements", ",") or j == end:
                first = j + 1 if j < end else None
                j += 1
            elif self.is_(j, "<") and (k := self.angles(j)) > j:
                if first is not None:
                    bases.append(self.source(first, j))
                    first = None
                j = k
            else:
                j = self.partner[j] + 1 if self.is_(j, *PAIRS) else j + 1
        return [b for b in bases if b]

    def note_of(self, i: int) -> str | None:
        """The last comment between the token before i and i, unless it ends the line of that token."""
        span = self.notes.get(i)
        if span is None:
            return None
        before = self.text[self.ends[i - 1] : span[0]] if i else "\n"
        return self.text[slice(*span)] if "\n" in before or self.text[span[0] : span[0] + 2] == "/*" else None

    # --- declarations ---

    def add(self, name: str, kind: str, first: int, behind: int, top: int, exported: bool = False, owner: str | None = None, params: list[dict] | None = None, returns: str | None = None, bases: list[str] | None = None) -> str:
        start, end = self.place(self.starts[first]), self.place(self.ends[max(first, min(behind, len(self.kinds)) - 1)])
        self.symbols.append({"what": "symbol", "name": name, "kind": kind, "owner": owner, "line": start[0], "col": start[1], "end_line": end[0], "end_column": end[1], "exported": exported, "params": params, "returns": returns or None, "bases": bases, "note": self.note_of(top)})
        return f"{owner}.{name}" if owner else name

    def parameters(self, i: int, end: int) -> list[dict]:
        """Parameters between tokens i and end: names without dots, marks and accessibility words."""
        out, seen = [], self.seen
        while i < end:
            while self.is_(i, "public", "private", "protected", "readonly", "override") and (self.word(i + 1) or self.is_(i + 1, "{", "[")) or self.word(i) and self.texts[i].startswith("@"):
                i = self.decorator(i) if self.texts[i].startswith("@") else i + 1
            rest = self.is_(i, "...")
            i += rest
            first, j = i, i
            while j < end and seen[j] not in ("?", ":", "=", ","):
                j = self.partner[j] + 1 if seen[j] in PAIRS else j + 1
            name = self.source(first, j)
            j += self.is_(j, "?")
            hint = default = None
            if self.is_(j, ":"):
                k = min(self.type_end(j + 1, "=", ","), end)
                hint, j = self.source(j + 1, k), k
            if self.is_(j, "="):
                k = j + 1
                while k < end and seen[k] != ",":
                    k = self.partner[k] + 1 if seen[k] in PAIRS else k + 1
                default, j = self.source(j + 1, k), k
            if name:
                out.append({"name": name, "type_hint": hint, "default_value": default, "kind": "args" if rest else "positional"})
            while j < end and not self.is_(j, ","):
                j += 1
            i = j + 1
        return out

    def signature(self, i: int) -> tuple[list[dict], str, int] | None:
        """(parameters, return type, behind it) of the optional type parameters and bracket at i."""
        i = self.angles(i)
        if not self.is_(i, "("):
            return None
        close = self.partner[i]
        behind, returns = close + 1, ""
        if self.is_(behind, ":"):
            end = self.type_end(behind + 1, "{", "=>", "=", ",")
            returns, behind = self.source(behind + 1, end), end
        return self.parameters(i + 1, close), returns, behind

    def function(self, i: int, first: int, top: int, name: str | None, kind: str, exported: bool, owner: str | None = None) -> int | None:
        """A function whose type parameters or bracket stand at i; its body waits. Gives what follows it."""
        sig = self.signature(i)
        if sig is None:
            return None
        params, returns, j = sig
        behind = self.partner[j] + 1 if self.is_(j, "{") else j + self.is_(j, ";")
        caller = self.add(name, kind, first, behind, top, exported, owner, params, owner if name == "constructor" and owner else returns)
        if self.is_(j, "{"):
            self.waiting.append((j + 1, self.partner[j], caller))
        return behind

    def class_(self, i: int, first: int, top: int, exported: bool, name: str | None = None) -> int:
        """The class whose keyword stands at i; gives what follows it."""
        j = i + 1
        if self.word(j) and not self.is_(j, "extends", "implements"):
            name = name or self.texts[j]
            j += 1
        j = self.angles(j)
        body = j
        while body < len(self.kinds) and not self.is_(body, "{"):
            body = self.partner[body] + 1 if self.is_(body, "(", "[") else body + 1
        close = self.partner[body] if body < len(self.kinds) else body
        if name:
            self.add(name, "class", first, close + 1, top, exported, bases=self.heritage(j, body))
            self.members(body + 1, close, name, exported)
        return close + 1

    def members(self, i: int, end: int, owner: str, exported: bool) -> None:
        """Methods and constructors of a class body; what properties are given is not looked into."""
        while i < end:
            first = top = i
            while self.word(i) and self.texts[i].startswith("@"):
                i = self.decorator(i)
            seen = set()
            while self.word(i) and self.texts[i] in MODIFIERS and not self.is_(i + 1, "(", "=", ":", ";", "?", "!", "<", "}"):
                seen.add(self.texts[i])
                i += 1
            i += self.is_(i, "*")
            if i >= end:
                return
            name, j = self.texts[i], i + 1
            if self.is_(i, "["):
                name, j = self.source(i, self.partner[i] + 1), self.partner[i] + 1
            elif self.kinds[i] == VALUE:
                name = name.strip("\"'")
            j += self.is_(j, "?", "!")
            behind = None
            if (self.is_(j, "(") or self.angles(j) > j) and (self.kinds[i] != SIGN or self.is_(i, "[")):
                kind = "class_method" if "static" in seen else "method"
                behind = self.function(j, first, top, name, kind, exported, owner)
            if behind is None:
                behind = self.partner[i] + 1 if self.is_(i, "{", "(") else self.value_end(i + 1, end)
                behind += self.is_(behind, ";", ",")
            i = max(behind, i + 1)

    def decorator(self, i: int) -> int:
        i += 1
        while self.is_(i, "."):
            i += 2
        return self.partner[i] + 1 if self.is_(i, "(") else i

    def value_end(self, i: int, end: int) -> int:
        """Behind the expression at i: at a comma, a semicolon, a closing bracket, or a line that can't go on."""
        j = i
        while j < end:
            if self.is_(j, ",", ";", ")", "]", "}"):
                return j
            if j > i and self.new_line(j) and self.begins_statement(j):
                return j
            j = self.partner[j] + 1 if self.seen[j] in PAIRS else j + 1
        return end

    def begins_statement(self, j: int) -> bool:
        """Whether token j, first on its line, begins a statement: neither it nor the token before it joins them."""
        before, t = self.seen[j - 1], self.seen[j]
        open_end = self.kinds[j - 1] == SIGN and before not in (")", "]", "}", "++", "--") or before in BEFORE_PATTERN
        joins = self.kinds[j] == SIGN and t not in ("{", "[", "(") or t in ("in", "of", "instanceof", "as")
        return not open_end and not joins and self.texts[j] != "`"

    def variables(self, i: int, end: int, top: int, exported: bool, caller: str | None) -> int:
        """Declarators behind const, let or var; those that are functions or classes become symbols."""
        while i < end:
            first = i
            named = self.word(i)
            j = i + 1 if named else self.partner[i] + 1 if self.is_(i, "{", "[") else i + 1
            j += self.is_(j, "!")
            if self.is_(j, ":"):
                j = self.type_end(j + 1, "=", ",")
            if self.is_(j, "in", "of"):
                return j
            if self.is_(j, "="):
                j = self.initialised(self.texts[first] if named else None, j + 1, end, first, top, exported, caller)
            if not self.is_(j, ","):
                return max(j, first + 1)
            i = j + 1
        return end

    def initialised(self, name: str | None, i: int, end: int, first: int, top: int, exported: bool, caller: str | None) -> int:
        """The value at i, given to ``name``; gives what follows it."""
        stop = self.value_end(i, end)
        j = i + (self.is_(i, "async") and not self.new_line(i + 1))
        kind = "async_function" if j > i else "function"
        if name and self.is_(j, "function"):
            k = j + 1 + self.is_(j + 1, "*")
            k += self.word(k)
            behind = self.function(k, first, top, name, kind, exported)
            if behind is not None:
                return behind
        elif name and self.is_(j, "class"):
            return self.class_(j, first, top, exported, name)
        elif name and (arrow := self.arrow(j)) is not None:
            params, returns, body = arrow
            block = self.is_(body, "{")
            behind = self.partner[body] + 1 if block else stop
            own = self.add(name, kind, first, behind, top, exported, None, params, returns)
            self.waiting.append((body + block, behind - block, own))
            return behind
        self.waiting.append((i, stop, caller))
        return stop

    def arrow(self, i: int) -> tuple[list[dict], str, int] | None:
        """(parameters, return type, body) if an arrow function begins at i."""
        if self.word(i) and self.is_(i + 1, "=>"):
            return self.parameters(i, i + 1), "", i + 2
        sig = self.signature(i)
        return (sig[0], sig[1], sig[2] + 1) if sig and self.is_(sig[2], "=>") else None

    def import_(self, i: int) -> int:
        """An import declaration whose keyword stands at i; gives what follows it."""
        j = i + 1
        while j < len(self.kinds) and not self.is_(j, ";") and self.kinds[j] != VALUE:
            j = self.partner[j] + 1 if self.is_(j, "{") else j + 1
        if j >= len(self.kinds) or self.kinds[j] != VALUE or not self.is_(j - 1, "from"):
            return j + 1
        module, line = self.texts[j].strip("\"'"), self.place(self.starts[i])[0]
        k = i + 1 + (self.is_(i + 1, "type") and not self.is_(i + 2, ",", "from"))
        put = lambda **row: self.imports.append({"what": "import", "module": module, "line": line, "col": len(self.imports), **row})
        while k < j - 1:
            if self.is_(k, "*"):
                put(name=None, alias=self.texts[k + 2])
                k += 3
            elif self.is_(k, "{"):
                close, k = self.partner[k], k + 1
                while k < close:
                    k += self.is_(k, "type") and not self.is_(k + 1, ",", "as", "}")
                    renamed = self.is_(k + 1, "as")
                    put(name=self.texts[k], alias=self.texts[k + 2] if renamed else None)
                    k += 3 if renamed else 1
                    k += self.is_(k, ",")
                k = close + 1
            else:
                if self.word(k):
                    put(name=self.texts[k], alias=None)
                k += 1
        return j + 1

    # --- statements and calls ---

    def call(self, i: int, caller: str | None) -> None:
        """The call whose bracket (or type arguments) follow token i - 1, a word."""
        first, seen, kinds = i - 1, self.seen, self.kinds
        while first >= 2 and seen[first - 1] in (".", "?.") and kinds[first - 2] == WORD:
            first -= 2
        chain = self.texts[first] if first == i - 1 else "".join("." if t == "?." else t for t in self.texts[first:i])
        if seen[first - 1] in (".", "?."):
            first, chain = first - 1, "." + chain
        if seen[first - 1] == "new":
            first -= 1
        line, col = self.place(self.starts[first])
        head, dot, rest = chain.partition(".")
        chain = {"this": "self", "super": "super()"}.get(head, head) + dot + rest
        self.calls.append({"what": "call", "name": chain, "owner": caller, "line": line, "col": col})

    def read(self, i: int, end: int, caller: str | None) -> None:
        """Statements and expressions from token i on; bodies of declarations are put aside for later."""
        top = None  # where the declaration with its modifiers begins
        kinds, seen = self.kinds, self.seen
        while i < end:
            if kinds[i] != WORD:
                i, top = i + 1, None
                continue
            t = seen[i]
            if seen[i - 1] in (".", "?."):
                if self.called(i):
                    self.call(i + 1, caller)
                i, top = i + 1, None
                continue
            head = i if top is None else top
            exported = "export" in seen[head:i]
            if t.startswith("@"):
                i, top = self.decorator(i), head
            elif t in ("export", "default", "declare", "abstract", "async") and not self.is_(i + 1, "(", "=", ".", ",", "=>", ":", ")", ";"):
                i, top = i + 1, head
            elif t == "import" and not self.is_(i + 1, "(", "."):
                i, top = self.import_(i), None
            elif t == "class" and (self.word(i + 1) or self.is_(i + 1, "{")):
                i, top = self.class_(i, head, head, exported), None
            elif t == "function":
                i, top = self.function_statement(i, head, exported, caller), None
            elif t in ("const", "let", "var") and not self.is_(i + 1, "enum") and (self.word(i + 1) or self.is_(i + 1, "{", "[")):
                i, top = self.variables(i + 1, end, head, exported, caller), None
            elif t in ("interface", "namespace", "module", "enum") and self.word(i + 1) and not self.new_line(i + 1):
                i, top = self.shape(i, end), None
            elif seen[i + 1] == "(" and self.object_method(i):
                i, top = i + 2, None
            else:
                if t not in NO_CALL and (self.called(i) or self.plain_new(i)):
                    self.call(i + 1, caller)
                i, top = i + 1, None

    def called(self, i: int) -> bool:
        """Whether arguments follow the word at i, perhaps behind a question mark or type arguments."""
        t = self.seen[i + 1]
        return t == "(" or t == "?." and self.is_(i + 2, "(") or t == "<" and self.is_(self.angles(i + 1), "(")

    def plain_new(self, i: int) -> bool:
        """new a.B without a bracket."""
        first = i
        while self.seen[first - 1] == "." and self.word(first - 2):
            first -= 2
        return self.seen[first - 1] == "new" and not self.is_(i + 1, ".", "(", "<")

    def function_statement(self, i: int, head: int, exported: bool, caller: str | None) -> int:
        """A function at i: a symbol where it is a statement with a name, otherwise part of what is around it."""
        statement = not head or self.seen[head - 1] in (";", "{", "}") or self.new_line(head) and self.begins_statement(head) or any(self.is_(k, "export", "default") for k in range(head, i))
        j = i + 1 + self.is_(i + 1, "*")
        if self.word(j) and statement:
            kind = "async_function" if any(self.is_(k, "async") for k in range(head, i)) else "function"
            behind = self.function(j + 1, head, head, self.texts[j], kind, exported)
            if behind is not None:
                return behind
        j += self.word(j)
        j = self.angles(j)
        return self.partner[j] + 1 if self.is_(j, "(") else j

    def shape(self, i: int, end: int) -> int:
        """Behind an interface or enum; a namespace is read like a block."""
        if self.texts[i] in ("namespace", "module"):
            return i + 2
        while i < end and not self.is_(i, "{", ";"):
            i += 1
        return self.partner[i] + 1 if self.is_(i, "{") else i

    def object_method(self, i: int) -> bool:
        """Whether ``name(...) {`` at i is a method of an object literal and no call."""
        close = self.partner[i + 1]
        if self.seen[close + 1] not in ("{", ":"):
            return False
        opens = self.is_(close + 1, "{") or self.is_(close + 1, ":") and self.is_(self.type_end(close + 2, "{", ","), "{")
        before = i - 1 - sum(self.is_(i - 1 - k, "async", "get", "set", "*") for k in range(2))
        return opens and self.texts[i] not in NO_CALL and self.is_(before, "{", ",")


COMMENT_OR_TEXT = re.compile(r"(\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)


NOTE_SIGN, NOTE_BEGIN, NOTE_END = re.compile(r"^\s*(?:\*|//+)\s?"), re.compile(r"^/\*\*?"), re.compile(r"\*/$")


def note_text(note: str | None) -> tuple[str | None, str | None]:
    """(summary, description) of a comment: its first line, and the others but @param and @return lines."""
    if not note:
        return None, None
    lines = [NOTE_SIGN.sub("", x).strip() for x in NOTE_END.sub("", NOTE_BEGIN.sub("", note)).split("\n")]
    told = [x for x in lines if x and not x.startswith(("@param", "@return"))]
    return (told[0], " ".join(told[1:]) or None) if told else (None, None)


def rows_of(text: str | None) -> list[dict]:
    """All rows of a file; symbols and calls in the order in which they stand there."""
    read = Reader(re.sub("\r\n?", "\n", text or ""))
    for x in read.symbols:
        x["summary"], x["description"] = note_text(x.pop("note"))
    return sorted(read.symbols, key=lambda x: (x["line"], x["col"])) + read.imports + sorted(read.calls, key=lambda x: (x["line"], x["col"]))
