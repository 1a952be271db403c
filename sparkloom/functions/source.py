"""Declarations, calls and imports of source texts, by their brackets or their indentation.

Comments and the insides of strings are blanked out first.  A brace language is
then cut at its braces and semicolons outside round brackets: what stands before
an opening brace says what the block is, and the stack of open blocks says what
it lies in.  Python is cut into logical lines, whose indentation does the same.
Each character is looked at a fixed number of times.

A fact is (fact, kind, name, qualified, start, end, detail); lines count from 1.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

Fact = tuple[str, str, str, str, int, int, str]

# fixed values: words before round brackets that are no calls or methods
KEYWORDS = frozenset(
    """if for while switch catch return new typeof sizeof await async function foreach using lock when and or not nameof throw else do try finally
    fixed checked unchecked delegate base this super in is as with select from where defer go func""".split()
)
#: Words of Python before round brackets that are no calls.
PYTHON_WORDS = frozenset("if elif while for in and or not is return yield await lambda assert del raise except with as import from def class else".split())
# fixed values: what SQL objects are made by, and what names others; words after these that are no names
CREATED = re.compile(r"\bCREATE\s+(?:OR\s+(?:ALTER|REPLACE)\s+)?(?:UNIQUE\s+)?(?:(?:NON)?CLUSTERED\s+)?(TABLE|VIEW|PROCEDURE|PROC|FUNCTION|TRIGGER)\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w$\[\]\"`.]+)", re.I)
NAMED = re.compile(r"\b(?:FROM|JOIN|INTO|UPDATE|EXEC(?:UTE)?|REFERENCES)\s+([\w$\[\]\"`.]+)", re.I)
NO_OBJECTS = frozenset("select values set where the dbo as tmp inserted deleted".split())

_BRACES = ("csharp", "java", "typescript", "javascript", "go")
_SLASHED = re.compile(r"//[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/)?|\"(?:[^\"\\\n]|\\.)*+\"?|'(?:[^'\\\n]|\\.)*+'?|`(?:[^`\\]|\\.)*+`?", re.S)
_DASHED = re.compile(r"--[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/)?|'(?:[^'\\\n]|\\.)*+'?", re.S)
_HASHED = re.compile(r"#[^\n]*|\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+(?:\"\"\")?|'''(?:[^'\\]|\\.|'(?!''))*+(?:''')?|\"(?:[^\"\\\n]|\\.)*+\"?|'(?:[^'\\\n]|\\.)*+'?", re.S)
_CUT = re.compile(r"[{};()]")
_CALLED = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
_TYPE = re.compile(r"\b(class|interface|struct|enum|record)\s+([A-Za-z_]\w*)")
_NAME = re.compile(r"([A-Za-z_]\w*)\s*(?:<[^<>()]*>)?\s*\(")
_MARK = re.compile(r"\s*(?:@[\w.]+(?:\([^()]*\))?|\[[^\[\]]*\])")
_GO_FUNCTION = re.compile(r"\s*func\s+(?:\(\s*\w*\s*\*?(\w+)[^()]*\)\s*)?(\w+)\s*(?:\[[^\[\]]*\])?\(")
_GO_TYPE = re.compile(r"\s*type\s+(\w+)\s+(struct|interface)\b")
_ARROW = re.compile(r"\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\b[^=]*=(?!=)")
_CONSTANT = re.compile(r"\s*(export\s+)?(?:const|let|var)\s+(\w+)\b[^=]*=(?!=)")
_ALIAS = re.compile(r"\s*(?:export\s+)?type\s+(\w+)\s*(?:<[^<>]*>)?\s*=")
_SPEC = re.compile(r"""\b(?:from|import|require\()\s*(['"])([^'"\n]+)\1""")
_IMPORTS = {
    "java": re.compile(r"^[ \t]*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;", re.M),
    "csharp": re.compile(r"^[ \t]*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", re.M),
}
_PACKAGES = {"java": ("package", re.compile(r"^[ \t]*package\s+([\w.]+)\s*;", re.M)), "csharp": ("namespace", re.compile(r"^[ \t]*namespace\s+([\w.]+)", re.M)), "go": ("package", re.compile(r"^[ \t]*package\s+(\w+)", re.M))}
_GO_IMPORT = re.compile(r'^import\s+(?:[\w.]+\s+)?"([^"\n]+)"|^[ \t]+(?:[\w.]+\s+)?"([^"\n]+)"[ \t]*$', re.M)


def blanked(text: str, language: str) -> str:
    """The text with comments and the insides of strings as blanks; line ends and lengths stay."""
    pattern = _HASHED if language == "python" else _DASHED if language == "sql" else _SLASHED

    def blank(m: re.Match) -> str:
        found = m[0]
        spaces = "\n".join(" " * len(part) for part in found.split("\n"))
        quoted = found[0] in "\"'`" and len(found) > 1 and found[-1] == found[0]
        return found[0] + spaces[1:-1] + found[-1] if quoted and "\n" not in (found[0], found[-1]) else spaces

    return pattern.sub(blank, text)


class Lines:
    """Line numbers of offsets."""

    def __init__(self, text: str):
        self.ends = [m.start() for m in re.finditer("\n", text)]

    def of(self, at: int) -> int:
        return bisect_right(self.ends, at - 1) + 1 if at else 1


def _calls(blank: str, lines: Lines, spans: list[tuple[int, int, str, str]], python: bool = False) -> Iterator[Fact]:
    """Each name called once a line, with the outermost function it lies in; spans (start, end, name, qualified) of functions in lines.

    Calls outside of functions count in Python alone, a function's of itself in Python too.
    """
    outer: list[tuple[int, int, str, str]] = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not outer or s[0] > outer[-1][1]:
            outer.append(s)
    starts, seen = [s[0] for s in outer], set()
    for m in _CALLED.finditer(blank):
        name, line = m[1], lines.of(m.start())
        k = bisect_right(starts, line) - 1
        holder = outer[k] if k >= 0 and line <= outer[k][1] else None
        if (name, line) in seen:
            continue
        if python:
            if name in PYTHON_WORDS or re.search(r"\b(?:def|class)\s+$", blank[max(m.start() - 40, 0) : m.start()]):
                continue
        elif name in KEYWORDS or holder is None or name == holder[2]:
            continue
        seen.add((name, line))
        yield "call", "calls", name, holder[3] if holder else "", line, line, ""


#: Words that begin a statement on a line of its own, in languages where a line end can end one.
_STARTS = {
    "go": re.compile(r"^[ \t]*(?:func|type|var|const|import|package)\b", re.M),
    "typescript": re.compile(r"^[ \t]*(?:export|default|async|function|const|let|var|class|interface|enum|type|abstract|import|declare)\b", re.M),
}
_STARTS["javascript"] = _STARTS["typescript"]


def _statements(language: str, head: str, owner: str | None) -> list[int]:
    """Where the statements of a stretch begin; in a script's type the last is the line of the name before the last round brackets."""
    if language not in _STARTS:
        return [0]
    if owner is None:
        return [0, *(m.start() for m in _STARTS[language].finditer(head) if m.start())]
    depth, at = 0, head.rfind(")")
    while at >= 0:
        depth += (head[at] == ")") - (head[at] == "(")
        if not depth:
            break
        at -= 1
    begin = head.rfind("\n", 0, max(at, 0)) + 1
    return [0, begin] if begin else [0]


def _header(language: str, head: str, owner: str | None, ends: str) -> tuple[str, str, str] | None:
    """Kind, name and owner of what a stretch before ``ends`` ({ or ;) declares, or None."""
    while m := _MARK.match(head):
        if m.end() == 0 or language not in ("java", "csharp"):
            break
        head = head[m.end() :]
    if language == "go":
        if m := _GO_TYPE.match(head):
            return m[2], m[1], ""
        m = _GO_FUNCTION.match(head)
        return ("method" if m[1] else "function", m[2], m[1] or "") if m and ends == "{" else None
    if ends == "{" and (m := _TYPE.search(head)) and "(" not in head[: m.start()] and "=" not in head[: m.start()]:
        return "class" if m[1] == "record" else m[1], m[2], ""
    script = language in ("typescript", "javascript")
    if script:
        if m := _ALIAS.match(head):
            return "type", m[1], ""
        if (m := _ARROW.match(head)) and "=>" in head[m.end() :]:
            return "function", m[1], ""
        if owner is None and (m := _CONSTANT.match(head)):
            return ("variable", m[2], "") if m[1] or (m[2].isupper() and len(m[2]) > 1) else None
        if m := re.match(r"\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", head):
            return ("function", m[1], "") if ends == "{" else None
        if ends != "{":
            return None
    if owner is None:
        return None
    m = _NAME.search(head)
    # a member: nothing is assigned before its name, and without a body it has a type before it
    if not m or m[1] in KEYWORDS or "=" in head[: m.start()] or "." in head[max(m.start() - 1, 0) : m.start()]:
        return None
    return ("method", m[1], "") if ends == "{" or head[: m.start()].split() else None


def _word_at(text: str, word: str, start: int, stop: int) -> int:
    """Where the word stands in text[start:stop], as \\b would find it: names are many, and a pattern for each would be compiled anew."""
    inner = lambda k: start <= k < stop and (text[k].isalnum() or text[k] == "_")
    at = text.index(word, start, stop)
    while inner(at - 1) or inner(at + len(word)):
        at = text.index(word, at + 1, stop)
    return at


def _braced(language: str, blank: str, lines: Lines, calls: bool = True) -> Iterator[Fact]:
    """Types, functions and members, each as soon as its block ends; then, on wish, the calls in them."""
    # of each open block: its declaration, the type of its members, and what stood before it where it lies in round brackets
    open_: list[tuple[Fact | None, str | None, tuple[int, list] | None]] = []
    begin, depth, spans = 0, 0, []
    pieces: list[tuple[int, int]] = []  # the present stretch, without blocks in its round brackets

    def declared(end: int, ends: str) -> list[Fact | None]:
        """What the stretch up to ``end`` declares: statements that end with a line, and the one that ends here."""
        owner = open_[-1][1] if open_ else None
        parts = [*pieces, (begin, end)]
        head = "".join(blank[a:b] for a, b in parts)
        starts = _statements(language, head, owner)
        out: list[Fact | None] = []
        for start, stop in zip(starts, [*starts[1:], len(head)]):
            found = _header(language, head[start:stop], owner, ends if stop == len(head) else ";")
            if not found:
                out.append(None)
                continue
            kind, name, of = found
            at = _word_at(head, name, start, stop)
            for a, b in parts:
                if at < b - a:
                    break
                at -= b - a
            qualified = f"{of or owner}.{name}" if kind == "method" and (of or owner) else name
            line = lines.of(a + at)
            out.append(("symbol", kind, name, qualified, line, line, " ".join(head[start:stop].split())[:200]))
        return out

    for m in _CUT.finditer(blank):
        c, at = m[0], m.start()
        if c in "()":
            depth = depth + 1 if c == "(" else max(depth - 1, 0)
            continue
        if depth and c == ";":
            continue
        if c == "{" and depth:
            open_.append((None, None, (depth, [*pieces, (begin, at)])))
            depth = 0
        elif c == "{":
            *before, fact = declared(at, c)
            yield from filter(None, before)
            inside_type = fact and fact[1] in ("class", "interface", "struct", "enum")
            open_.append((fact, fact[2] if inside_type else None, None))
        elif c == ";":
            for fact in filter(None, declared(at, c)):
                yield fact
                if fact[1] in ("method", "function"):
                    spans.append((fact[4], lines.of(at), fact[2], fact[3]))
        elif open_:
            if language in _STARTS and not open_[-1][2]:
                yield from filter(None, declared(at, ";"))
            fact, _, outer = open_.pop()
            if outer:
                depth, pieces = outer
                begin = at + 1
                continue
            if fact:
                done = (*fact[:5], lines.of(at), fact[6])
                yield done
                if done[1] in ("method", "function"):
                    spans.append((done[4], done[5], done[2], done[3]))
        begin, pieces, depth = at + 1, [], 0
    if language in _STARTS:
        yield from filter(None, declared(len(blank), ";"))
    for fact, *_ in open_:  # never closed
        if fact:
            last = lines.of(max(len(blank) - 1, 0))
            yield (*fact[:5], last, fact[6])
            if fact[1] in ("method", "function"):
                spans.append((fact[4], last, fact[2], fact[3]))
    if calls:
        yield from _calls(blank, lines, spans)


def _braced_imports(language: str, text: str, blank: str, lines: Lines) -> Iterator[Fact]:
    """Imported names; where they are strings, their text is looked up at the place of the blanked one."""
    if language in _PACKAGES:
        kind, pattern = _PACKAGES[language]
        for m in pattern.finditer(blank):
            yield "provides", kind, m[1], m[1], lines.of(m.start(1)), lines.of(m.start(1)), ""
    if language in _IMPORTS:
        found = ((m[1], m.start(1)) for m in _IMPORTS[language].finditer(blank))
    elif language == "go":
        found = ((m[1] or m[2], m.start()) for m in _GO_IMPORT.finditer(text))
    else:
        found = ((m[2], m.start()) for m in _SPEC.finditer(text) if blank[m.start() : m.start() + 4].strip())
    for spec, at in found:
        yield "import", "imports", spec, spec, lines.of(at), lines.of(at), ""


_UNQUOTED = str.maketrans("", "", "[]\"`")


def _sql(blank: str, lines: Lines, calls: bool = True) -> Iterator[Fact]:
    """Objects from their CREATE to the next one, and, on wish, what they name."""
    plain = lambda x: x.translate(_UNQUOTED).rstrip(".").split(".")[-1].lower()
    made = list(CREATED.finditer(blank))
    starts = [m.start() for m in made]
    for k, m in enumerate(made):
        end = starts[k + 1] if k + 1 < len(made) else len(blank)
        kind = "procedure" if m[1].lower() == "proc" else m[1].lower()
        name = plain(m[2])
        yield "symbol", kind, name, name, lines.of(m.start()), lines.of(max(m.start(), end - 1)), f"{m[1].upper()} {name}"
    for m in NAMED.finditer(blank) if calls else ():
        k = bisect_right(starts, m.start()) - 1
        owner, name = plain(made[k][2]) if k >= 0 else "", plain(m[1])
        if name and name not in NO_OBJECTS and name != owner:
            yield "call", "references", name, owner, lines.of(m.start()), lines.of(m.start()), ""


_LOGICAL = re.compile(r"[\n()\[\]{}\\]")
_DEFINED = re.compile(r"(async\s+def|def|class)\s+([A-Za-z_]\w*)")
_ASSIGNED = re.compile(r"([A-Za-z_]\w*)\s*(?::[^=]*)?=(?!=)\s*(?:[A-Za-z_][\w.]*\s*([(\[]))?")
_FIELD = re.compile(r"([A-Za-z_]\w*)\s*(?::(?!=)|=(?!=))")
_FROM = re.compile(r"from\s+(\.*)\s*([\w.]*)\s*import\b(.*)", re.S)


def _logical_lines(blank: str) -> Iterator[tuple[int, int]]:
    """Ranges of characters: a line goes on inside brackets and behind a backslash at its end."""
    begin, depth = 0, 0
    for m in _LOGICAL.finditer(blank):
        c = m[0]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(depth - 1, 0)
        elif c == "\n" and not depth and blank[m.start() - 1 : m.start()] != "\\":
            yield begin, m.start()
            begin = m.start() + 1
    if begin < len(blank):
        yield begin, len(blank)


def _python(blank: str, lines: Lines, calls: bool = True) -> Iterator[Fact]:
    """Classes and functions end with the last line that is indented more; constants, bound names and fields are lines of their own."""
    open_: list[list] = []  # [indent, kind, name, qualified, start, detail]
    spans, last, taken = [], 1, set()

    def close(to: int) -> Iterator[Fact]:
        while open_ and open_[-1][0] >= to:
            _, kind, name, qualified, start, detail = open_.pop()
            yield "symbol", kind, name, qualified, start, last, detail
            if kind != "class":
                spans.append((start, last, name, qualified))

    for begin, end in _logical_lines(blank):
        line = blank[begin:end]
        body = line.strip()
        if not body:
            continue
        indent = len(line) - len(line.lstrip())
        yield from close(indent)
        start = lines.of(begin + indent)
        holder = open_[-1] if open_ else None
        if m := _DEFINED.match(body):
            qualified = f"{holder[3]}.{m[2]}" if holder else m[2]
            kind = "class" if m[1] == "class" else "method" if holder and holder[1] == "class" else "function"
            taken.add(qualified)
            open_.append([indent, kind, m[2], qualified, start, " ".join(body.rstrip(":").split())[:200]])
        elif m := re.match(r"import\s+(.*)", body, re.S):
            for part in m[1].replace("\\", " ").split(","):
                spec = part.split(" as ")[0].strip()
                if spec:
                    yield "import", "imports", spec, spec, start, start, ""
        elif m := _FROM.match(body):
            names = [p.split(" as ")[0].strip() for p in re.sub(r"[()\\]", " ", m[3]).split(",")]
            yield "import", "imports", m[1] + m[2], m[1] + m[2], start, start, ",".join(n for n in names if n)
        elif not holder and (m := _ASSIGNED.match(body)) and not m[1].startswith("__") and m[1] not in taken:
            if (m[1].isupper() and len(m[1]) > 1) or (m[2] and not m[1].startswith("_")):
                taken.add(m[1])
                yield "symbol", "variable", m[1], m[1], start, lines.of(end - 1), m[1]
        elif holder and holder[1] == "class" and (m := _FIELD.match(body)) and m[1] not in PYTHON_WORDS and not (m[1].startswith("__") and m[1].endswith("__")):
            qualified = f"{holder[3]}.{m[1]}"
            if qualified not in taken:
                taken.add(qualified)
                yield "symbol", "field", m[1], qualified, start, lines.of(end - 1), " ".join(body.split())[:200]
        last = lines.of(end - 1)
    yield from close(-1)
    if calls:
        yield from _calls(blank, lines, spans, python=True)


def facts(language: str | None, text: str, wanted: tuple[str, ...] | None = None) -> Iterator[Fact]:
    """All facts of a text, or those of the kinds in ``wanted`` (symbol, call, import, provides); a language that isn't known has none."""
    if language not in (*_BRACES, "python", "sql"):
        return
    found = _every(language, text, *((wanted is None or kind in wanted) for kind in ("symbol", "call", "import")), wanted is None or "provides" in wanted)
    yield from found if wanted is None else (f for f in found if f[0] in wanted)


def _every(language: str, text: str, symbols: bool, calls: bool, imports: bool, provides: bool) -> Iterator[Fact]:
    """Steps that give nothing but what isn't asked for are left out; spans of symbols hold the calls."""
    blank, lines = blanked(text, language), Lines(text)
    if language == "sql":
        if symbols or calls:
            yield from _sql(blank, lines, calls)
    elif language == "python":
        yield from _python(blank, lines, calls)
    else:
        if symbols or calls:
            yield from _braced(language, blank, lines, calls)
        if imports or provides:
            yield from _braced_imports(language, text, blank, lines)
