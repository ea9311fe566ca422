"""Elements of a paper's source: headings, labels, citations, quotes, and the files it includes, imports or cites from.

A source is read once from left to right, as markup or, after a ``#`` and inside its parentheses and braces, as code;
brackets in code hold markup again. Comments (blocks may nest), raw text between backticks, formulas, links, strings and
escaped characters hold no elements. Beyond ``DEPTH`` nested levels brackets count as characters. Sources that end in the
middle of something are read as if it ended there.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

DEPTH = 100
#: Key words after which code goes on to the line's end.
STATEMENTS = frozenset("let set show if else for while return context in".split())
KEY = r"[^\W\d_](?:[\w\-:.]*\w)?"
MARKUP = re.compile(
    rf"(?P<escape>\\u\{{[0-9a-fA-F]+\}}|\\.)|(?P<link>https?://[^\s\])>\"]*)|(?P<comment>//[^\n]*|/\*)|(?P<raw>`+)|(?P<math>\$)|(?P<heading>(?:^|(?<=\n))[ \t]*=+(?=[ \t]))"
    rf"|(?P<ref>(?<![\w\\])@{KEY})|(?P<label><[\w\-:.]+>)|(?P<code>#(?=[^\W\d]|[({{\[]))|(?P<open>\[)|(?P<close>\])",
    re.DOTALL,
)
CODE = re.compile(r"(?P<comment>//[^\n]*|/\*)|(?P<raw>`+)|(?P<string>\"(?:\\.|[^\"\\])*\"?)|(?P<math>\$)|(?P<label><[\w\-:.]+>)|(?P<name>[^\W\d][\w\-]*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<end>[\n;])", re.DOTALL)
STRING = re.compile(r"\s*\"((?:\\.|[^\"\\])*)\"", re.DOTALL)
NESTED = re.compile(r"/\*|\*/")
FIRST_KEY = re.compile(rf"\s*(?:<({KEY})>|label\(\s*\"({KEY})\"\s*\))\s*(?:,|$)")
ATTRIBUTION = re.compile(rf"\battribution\s*:\s*(?:<({KEY})>|\[\s*@({KEY})\s*\])")
FORM, SUPPLEMENT = re.compile(r"\bform\s*:\s*\"([^\"]*)\""), re.compile(r"\bsupplement\s*:\s*\[([^\]]*)\]")


@dataclass
class Element:
    """kind: heading, label, citation, dynamic, quote, include, import or bibliography. value: title, name, key or path.
    text: a quote's wording, or a citation's supplement."""

    kind: str
    start: int
    value: str | None = None
    level: int | None = None
    form: str | None = None
    text: str | None = None


@dataclass
class Source:
    text: str
    found: list[Element] = field(default_factory=list)

    def comment(self, at: int, token: str) -> int:
        """Behind a comment that begins here."""
        if token != "/*":
            return at + len(token)
        depth = 1
        for m in NESTED.finditer(self.text, at + 2):
            depth += 1 if m[0] == "/*" else -1
            if not depth:
                return m.end()
        return len(self.text)

    def raw(self, at: int, ticks: str) -> int:
        if len(ticks) == 2:  # raw text of nothing
            return at + 2
        end = self.text.find(ticks, at + len(ticks))
        return len(self.text) if end < 0 else end + len(ticks)

    def math(self, at: int) -> int:
        m = re.compile(r"(?:\\.|[^$\\])*\$?", re.DOTALL).match(self.text, at + 1)
        return m.end()

    def skipped(self, m: re.Match) -> int | None:
        """Behind what holds no elements, if that begins here."""
        kind = m.lastgroup
        if kind == "comment":
            return self.comment(m.start(), m[0])
        if kind == "raw":
            return self.raw(m.start(), m[0])
        if kind == "math":
            return self.math(m.start())
        return m.end() if kind in ("escape", "link", "string") else None

    def markup(self, at: int, depth: int, closed: bool) -> int:
        """Reads markup to the end, or behind the bracket that closes it."""
        inner = 0
        while m := MARKUP.search(self.text, at):
            at = m.end()
            kind = m.lastgroup
            if (behind := self.skipped(m)) is not None:
                at = behind
            elif kind == "heading":
                end = self.text.find("\n", at)
                self.heading(m, len(self.text) if end < 0 else end)
            elif kind == "ref":
                own = re.compile(r"\[([^\]\n]*)\]").match(self.text, at)
                self.found.append(Element("citation", m.start(), m[0][1:], text=own and own[1]))
            elif kind == "label":
                self.found.append(Element("label", m.start(), m[0][1:-1]))
            elif kind == "code":
                at = self.expression(at, depth + 1)
            elif kind == "open":
                inner += 1
            elif kind == "close" and closed:
                if not inner:
                    return at
                inner -= 1
        return len(self.text)

    def heading(self, m: re.Match, end: int) -> None:
        level = m[0].count("=")
        self.found.append(Element("heading", m.end() - level, plain(self.text[m.end() : end]), level=level))

    def expression(self, at: int, depth: int) -> int:
        """Reads the code expression behind a hash."""
        if depth > DEPTH:
            return at
        if self.text[at] in "([{":
            return self.group(at, depth)
        m = CODE.match(self.text, at)
        name, at = m[0], m.end()
        if name in ("include", "import"):
            return self.path(name, m.start(), at)
        if name in STATEMENTS:
            return self.code(at, depth, None)
        return self.calls(name, m.start(), at, depth)

    def path(self, kind: str, start: int, at: int) -> int:
        if own := STRING.match(self.text, at):
            self.found.append(Element(kind, start, unescaped(own[1])))
            return own.end()
        return at

    def calls(self, name: str, start: int, at: int, depth: int) -> int:
        """Reads the parentheses and brackets behind a name, and what follows its methods."""
        args, first = None, None
        while at < len(self.text):
            if self.text[at] in "([":
                end = self.group(at, depth)
                if self.text[at] == "(" and args is None:
                    args = self.text[at + 1 : end - 1 if self.text[end - 1] == ")" else end]
                elif self.text[at] == "[" and first is None:
                    first = self.text[at + 1 : end - 1 if self.text[end - 1] == "]" else end]
                at = end
            elif method := re.compile(r"\.[^\W\d][\w\-]*(?=[(\[])").match(self.text, at):
                at = method.end()
            else:
                break
        self.called(name, start, args, first)
        return at

    def called(self, name: str, start: int, args: str | None, content: str | None) -> None:
        if name == "cite" and args is not None:
            own, form, more = FIRST_KEY.match(args), FORM.search(args), SUPPLEMENT.search(args)
            key = own and (own[1] or own[2])
            self.found.append(Element("citation" if key else "dynamic", start, key, form=form and form[1], text=more and more[1]))
        elif name == "quote" and content is not None:
            own = ATTRIBUTION.search(args or "")
            self.found.append(Element("quote", start, own and (own[1] or own[2]), text=plain(content)))
        elif name == "bibliography" and args is not None:
            for path in re.finditer(r"\"((?:\\.|[^\"\\])*)\"", re.split(r"\b[a-z]+\s*:", args)[0]):
                self.found.append(Element("bibliography", start, unescaped(path[1])))

    def group(self, at: int, depth: int) -> int:
        """Reads what stands between a bracket and the one that closes it."""
        if depth > DEPTH:
            return at + 1
        if self.text[at] == "[":
            return self.markup(at + 1, depth, True)
        return self.code(at + 1, depth, ")" if self.text[at] == "(" else "}")

    def code(self, at: int, depth: int, closer: str | None) -> int:
        """Reads code to its closing bracket, or to the end of the statement."""
        while m := CODE.search(self.text, at):
            at = m.end()
            if (behind := self.skipped(m)) is not None:
                at = behind
            elif m.lastgroup == "open":
                at = self.group(m.start(), depth + 1)
            elif m.lastgroup == "close":
                if m[0] == closer:
                    return at
                if closer is None:
                    return m.start()
            elif m.lastgroup == "end":
                if closer is None:
                    return m.start() if m[0] == "\n" else at
            elif m.lastgroup == "name":
                if m[0] in ("include", "import"):
                    at = self.path(m[0], m.start(), at)
                elif at < len(self.text) and self.text[at] in "([" and m[0] not in STATEMENTS:
                    at = self.calls(m[0], m.start(), at, depth + 1)
        return len(self.text)


def unescaped(text: str) -> str:
    return re.sub(r"\\u\{([0-9a-fA-F]+)\}|\\(.)", lambda m: (chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else "") if m[1] else {"n": "\n", "t": "\t", "r": "\r"}.get(m[2], m[2]), text, flags=re.DOTALL)


def plain(markup: str) -> str:
    """The words of markup: escapes resolved, marks, calls, labels and references left out, raw text kept."""
    out, at, s = [], 0, Source(markup)
    while m := MARKUP.search(markup, at):
        out.append(re.sub(r"[*_]", "", markup[at : m.start()]))
        at = m.end()
        kind = m.lastgroup
        if kind == "escape":
            out.append(unescaped(m[0]) if len(m[0]) > 2 else m[0][1])
        elif kind == "raw":
            at = s.raw(m.start(), m[0])
            out.append(markup[m.start() : at].strip("`"))
        elif kind == "link":
            out.append(m[0])
        elif kind == "math":
            at = s.math(m.start())
            out.append(markup[m.start() : at])
        elif kind == "comment":
            at = s.comment(m.start(), m[0])
        elif kind == "code":
            name = re.compile(r"[^\W\d][\w\-]*").match(markup, at)
            at = name.end() if name else at
            if at < len(markup) and markup[at] == "(":
                at = s.group(at, 1)
            if at < len(markup) and markup[at] == "[":
                end = s.group(at, 1)
                out.append(plain(markup[at + 1 : end - 1]) if end - at < len(markup) else markup[at:end])
                at = end
        elif kind in ("open", "close", "heading"):
            out.append(m[0])
    out.append(re.sub(r"[*_]", "", markup[at:]))
    return " ".join("".join(out).replace("~", " ").split())


def elements(text: str) -> list[Element]:
    """A source's elements, in their order."""
    s = Source(text)
    s.markup(0, 0, False)
    return sorted(s.found, key=lambda e: e.start)


def placed(text: str) -> list[dict]:
    """Elements with line and column (from 0), the line of the chapter they are in (a heading is in its own), a heading's
    parent (the last one above of a smaller level), and the lines of the paragraph around them."""
    feeds = [-1, *(m.start() for m in re.finditer("\n", text))]
    blank = [k for k, line in enumerate(text.split("\n")) if not line.strip()]
    above: list[tuple[int, int]] = []
    chapter, out = None, []
    for e in elements(text):
        k = bisect_right(feeds, e.start - 1) - 1
        parent = None
        if e.kind == "heading":
            while above and above[-1][0] >= e.level:
                above.pop()
            parent, chapter = above[-1][1] if above else None, k
            above.append((e.level, k))
        b = bisect_right(blank, k)
        first, last = blank[b - 1] + 1 if b else 0, blank[b] - 1 if b < len(blank) else len(feeds) - 1
        out.append({"kind": e.kind, "line": k, "col": e.start - feeds[k] - 1, "value": e.value, "level": e.level, "form": e.form, "text": e.text, "chapter": chapter, "parent": parent, "first_line": first, "last_line": last})
    return out
