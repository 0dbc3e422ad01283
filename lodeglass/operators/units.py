"""Functions, classes and symbols of one file's lines, in plain Python: one pass over the lines, whatever is asked.

`lodeglass.operators.parse` brings these to columns, a batch of files at a
time. Extents come from tables made once per file (depth of braces, next blank
line, next line at the margin), so that neither many headers nor blocks that
never close make a file costly.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

from lodeglass import config
from lodeglass.operators import patterns

# Fixed value: white space, as scripts trim it.
SPACE = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Lines over which the least depth of braces is noted.
_BLOCK = 128


@dataclass(frozen=True)
class Reach:
    """How many lines a function of either kind may reach, and how many follow a bare signature; None is as far as it goes."""

    brace: int | None = None
    indent: int | None = None
    signature: int | None = None


#: Limits of the report.
REPORTED = Reach(config.BRACE_LINES, config.INDENT_LINES, config.SIGNATURE_LINES)
WHOLE = Reach()

_compiled = lambda found: [re.compile(p, re.ASCII) for p in found]
_FUNCTIONS, _BRACE_CLASS, _BRACE_METHOD = _compiled(patterns.BRACE_FUNCTIONS), _compiled([patterns.BRACE_CLASS]), _compiled([patterns.BRACE_METHOD])
_DEF, _CLASS, _METHOD = _compiled([patterns.INDENT_FUNCTION]), _compiled([patterns.INDENT_CLASS]), _compiled([patterns.INDENT_METHOD])
_PLAIN = list(zip(["interface", "type", "enum"], _compiled([patterns.INTERFACE, patterns.TYPE, patterns.ENUM])))
_SIGNATURES = {lang: re.compile("|".join(f"(?:{p})" for p in found), re.ASCII) for lang, found in patterns.SIGNATURES.items()}
_CALLED = re.compile(r"(?:^|(?<=\s))(\w+)\s*\(", re.ASCII)
_RECEIVER = re.compile(r"^func\s+\([^)]*\)", re.ASCII)
_SIG_NAME, _SIG_NAME_PLAIN = re.compile(r"(\w+)\s*(?:<[^>(]*>)?\s*\(", re.ASCII), re.compile(r"(\w+)\s*\(", re.ASCII)
_BARRED = frozenset(config.NO_FUNCTION)


def _name(line: str, found: list[re.Pattern], barred: frozenset = frozenset()) -> str | None:
    """Name that the first fitting pattern gives and that isn't barred."""
    for p in found:
        m = p.search(line)
        if m and m[1] not in barred:
            return m[1]
    return None


class Braces:
    """Ends of brace blocks: where as many are closed as opened, or, before any opens, at a blank line or a semicolon."""

    def __init__(self, lines: list[str]):
        n = len(lines)
        self.n, self.depth, depth = n, [0] * n, 0
        self.opens, self.bare = [n] * (n + 1), [n] * (n + 1)  # the next such line from here on
        for k, line in enumerate(lines):
            depth += line.count("{") - line.count("}")
            self.depth[k] = depth
        for k in range(n - 1, -1, -1):
            tail = lines[k].rstrip(SPACE)
            self.opens[k] = k if "{" in lines[k] else self.opens[k + 1]
            self.bare[k] = k if not tail or tail[-1] == ";" else self.bare[k + 1]
        self.least = [min(self.depth[k:k + _BLOCK]) for k in range(0, n, _BLOCK)]

    def end(self, at: int, reach: int | None) -> int:
        """Last line of the block whose header is line `at`, from 0."""
        last = self.n - 1 if reach is None else min(self.n, at + reach) - 1
        first, bare = self.opens[at], self.bare[at + 1]
        if bare < first or first >= self.n:
            return min(bare, last)
        level = self.depth[at - 1] if at else 0
        k = first
        while k <= last:
            if self.depth[k] <= level:
                return k
            k += 1
            if k % _BLOCK == 0:
                while k <= last and self.least[k // _BLOCK] > level:
                    k += _BLOCK
        return last


class Indents:
    """Ends of indented blocks: before the next line at the margin, but for the one right behind the header."""

    def __init__(self, lines: list[str]):
        self.n = len(lines)
        self.margin = [self.n] * (self.n + 2)
        for k in range(self.n - 1, -1, -1):
            self.margin[k] = k if lines[k] and lines[k][0] not in SPACE else self.margin[k + 1]

    def end(self, at: int, reach: int | None) -> int:
        last = self.n - 1 if reach is None else min(self.n, at + reach) - 1
        return min(self.margin[min(at + 2, self.n)] - 1, last)


@dataclass(frozen=True)
class Unit:
    """A function or class; lines from 1."""

    name: str
    start_line: int
    end_line: int
    signature: str
    methods: tuple[str, ...] = ()


def _spanned(lines: list[str], ends, reach: int | None, found: list[re.Pattern], barred: frozenset = frozenset(), signs: tuple[str, ...] = ()) -> list[Unit]:
    out = []
    for k, line in enumerate(lines):
        if signs and not any(s in line for s in signs):
            continue
        name = _name(line, found, barred)
        if name is not None:
            out.append(Unit(name, k + 1, ends.end(k, reach) + 1, line.strip(SPACE)))
    return out


def _with_methods(classes: list[Unit], lines: list[str], found: list[re.Pattern], barred: frozenset, once: bool) -> list[Unit]:
    out = []
    for c in classes:
        names = [m for line in lines[c.start_line - 1: c.end_line] if (m := _name(line, found, barred)) is not None]
        out.append(Unit(c.name, c.start_line, c.end_line, c.signature, tuple(dict.fromkeys(names) if once else names)))
    return out


def brace_functions(lines: list[str], ends: Braces, reach: int | None) -> list[Unit]:
    return _spanned(lines, ends, reach, _FUNCTIONS, _BARRED, ("(", "=>", "<"))


def brace_classes(lines: list[str], ends: Braces, reach: int | None, methods: bool = True) -> list[Unit]:
    found = _spanned(lines, ends, reach, _BRACE_CLASS, signs=("class",))
    return _with_methods(found, lines, _BRACE_METHOD, _BARRED, True) if methods else found


def indent_functions(lines: list[str], ends: Indents, reach: int | None) -> list[Unit]:
    return _spanned(lines, ends, reach, _DEF, signs=("def",))


def indent_classes(lines: list[str], ends: Indents, reach: int | None, methods: bool = True) -> list[Unit]:
    found = _spanned(lines, ends, reach, _CLASS, signs=("class",))
    return _with_methods(found, lines, _METHOD, frozenset(), False) if methods else found


def signatures(lines: list[str], language: str | None) -> list[tuple[int, str]]:
    """(line from 0, trimmed line) of the signatures in a language without a parser."""
    fits = _SIGNATURES.get(language or "", _SIGNATURES[""]).search
    return [(k, line.strip(SPACE)) for k, line in enumerate(lines) if fits(line)]


def _first_places(lines: list[str], wanted: list[tuple[int, str]], trimmed: bool = True) -> list[tuple[int, str]]:
    """The same signatures, each at the first line that reads the same, 0 being the first; -1 if none does."""
    texts, first = {s for _, s in wanted}, {}
    for k, line in enumerate(lines):
        text = line.strip(SPACE) if trimmed else line
        if text in texts:
            first.setdefault(text, k)
    return [(first.get(s, -1), s) for _, s in wanted]


SCRIPTS = ("typescript", "javascript")


def _methods(classes: list[Unit], lines: list[str]) -> list[tuple]:
    """An entry per method name, at the first line of its class that seems to call or define it."""
    out = []
    for c in classes:
        wanted, first = set(c.methods), {}
        for k in range(c.start_line - 1, c.end_line) if wanted else ():
            for m in _CALLED.finditer(lines[k]):
                if m[1] in wanted:
                    first.setdefault(m[1], k)
        out += [(m, "method", first[m] + 1, first[m] + 1, lines[first[m]].strip(SPACE), c.name) for m in c.methods if m in first]
    return out


def symbols(lines: list[str], language: str | None, reach: Reach = REPORTED, indented: bool = True) -> list[tuple]:
    """(name, kind, line, end_line, signature, container) in the order in which they are found.

    With `indented`, signatures of other languages count wherever they stand,
    and a receiver is no name; without, only those at the left margin.
    """
    entries = lambda units, kind: [(u.name, kind, u.start_line, u.end_line, u.signature, None) for u in units]
    if language in SCRIPTS:
        ends = Braces(lines)
        classes = brace_classes(lines, ends, reach.brace)
        out = entries(brace_functions(lines, ends, reach.brace), "function") + entries(classes, "class") + _methods(classes, lines)
        for kind, p in _PLAIN:
            out += [(m[1], kind, k + 1, k + 1, line.strip(SPACE), None) for k, line in enumerate(lines) if kind in line and (m := p.search(line))]
        return out
    if language == "python":
        ends = Indents(lines)
        classes = indent_classes(lines, ends, reach.indent)
        return entries(indent_functions(lines, ends, reach.indent), "function") + entries(classes, "class") + _methods(classes, lines)
    out = []
    for at, sig in _first_places(lines, signatures(lines, language), indented):
        m = _SIG_NAME.search(_RECEIVER.sub("func", sig)) if indented else _SIG_NAME_PLAIN.search(sig)
        if m and at >= 0:
            out.append((m[1], "function", at + 1, at + 1, sig, None))
    return out


def _free(classes: list[Unit], functions: list[Unit]) -> list[Unit]:
    """Classes that no function and no class before holds."""
    starts, furthest = [], []
    for f in functions:  # in order of their lines
        starts.append(f.start_line)
        furthest.append(max(f.end_line, furthest[-1] if furthest else 0))
    out, reached = [], 0
    for c in classes:
        k = bisect.bisect_right(starts, c.start_line)
        if c.end_line > reached and (not k or furthest[k - 1] < c.end_line):
            out.append(c)
        reached = max(reached, c.end_line)
    return out


def unit_spans(lines: list[str], language: str | None, reach: Reach = REPORTED) -> list[tuple]:
    """(start_line, end_line, chunk_type, identifier): functions, then classes that nothing before holds; empty where there are neither."""
    if language in SCRIPTS or language == "python":
        if language == "python":
            ends = Indents(lines)
            functions, classes = indent_functions(lines, ends, reach.indent), indent_classes(lines, ends, reach.indent, False)
        else:
            ends = Braces(lines)
            functions, classes = brace_functions(lines, ends, reach.brace), brace_classes(lines, ends, reach.brace, False)
        spans = lambda units, kind: [(u.start_line, u.end_line, kind, u.name) for u in units]
        return spans(functions, "function") + spans(_free(classes, functions), "class")
    places, out = _first_places(lines, signatures(lines, language)), []
    heads = sorted({at for at, _ in places})
    for at, sig in places:
        name = re.split(r"\s+", sig.split("(")[0], flags=re.ASCII)[-1]
        k = bisect.bisect_right(heads, at)
        end = min(at + reach.signature, len(lines)) if reach.signature else heads[k] if k < len(heads) else len(lines)
        out.append((at + 1, end, "function", name))
    return out
