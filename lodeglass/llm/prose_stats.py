"""Statistics of one text that tell running prose from lists, tables, code, logs and junk."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

#: Names of the statistics, in the order of `statistics`. Those ending in share are shares of the text in units (paragraphs,
#: lines that stand for themselves) that are long enough for sentences, laid out in columns or stamped, use common words
#: as speech does, hold many signs, consist of words, end in punctuation; `common_share` and `opaque_share` are of words.
NAMES = [
    "log_words", "mean_word_length", "symbol_ratio", "digit_ratio", "common_share", "words_per_unit",
    "long_share", "laid_share", "spoken_share", "marked_share", "worded_share", "closed_share", "opaque_share",
]

#: Widths between which text is taken to be wrapped: narrower blocks are lists, wider lines whole paragraphs.
NARROWEST, WIDEST = 34, 120

# Signs that stand in sentences of the four languages.
_SENTENCE_SIGNS = r"\w\s.,;:!?'\"’‘“”„«»‹›()¿¡…–—/-"
_HARD = re.compile(rf"[^{_SENTENCE_SIGNS}]")
_MARK = re.compile(r"^\s*(?:(?:>+|//+|#+|\*+|--+|;+|[-+•‣·–—]|\[[ xX]?\]|\(?\d{1,3}[.)])\s+|>+)*")
_WORD = re.compile(r"^[^\W\d_]+(?:['’.-][^\W\d_]+)*$")
_NAME = re.compile(r"^[A-Za-z_][\w]*(?:[./-]\w+)*$|^\w+(?:/[\w.-]+)+$")
_COLUMNS = re.compile(r"\S(?: {3,}|\t+)\S")
_TIGHT_COMMA = re.compile(r"[^\s,;],[^\s\d]")
_STAMP = re.compile(r"^(?:.{0,38}?\b\d\d?:\d\d:\d\d|[\[{(<]?\w?\d{4}[-/.\d]|\d{9,}|\w+=|[{\[<])")
_INDEX = re.compile(r"^\d+(?:\.\d+)*\s.*\s\d+$|(?<!\.)\.{4,}+\s*+\d+$")
_DIGIT = re.compile(r"\d")
_CODE = re.compile(r"[()\[\]{}=<>]")
_TRIM = ".,;:!?\"'()[]{}<>«»“”„‘’…¿¡`*_–—-"
_CLOSE = tuple(".!?:…\"”»)")
_STOP = tuple(".!?…")


def tidy(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n").replace("\ufeff", "")


def _bare(token: str) -> str:
    return token.strip(_TRIM)


def _wrapped(block: list[str]) -> bool:
    """Whether nearly every line break of a block falls where the next word wouldn't have fitted."""
    width = max(map(len, block))
    if width < NARROWEST:
        return False
    if 2 * sum(bool(_CODE.search(x)) or x.endswith(("'", '"', ";")) for x in block) >= len(block):
        return False
    # marks that were taken off the lines may have had different widths
    forced = sum(len(a) + 1 + len(b.split(None, 1)[0]) > width - 3 for a, b in zip(block, block[1:]))
    words = sum(len(x.split()) for x in block)
    return forced >= 0.75 * (len(block) - 1) and words >= 3.2 * (len(block) - 1)


def units(text: str) -> Iterator[tuple[str, str, bool]]:
    """Paragraphs, unwrapped, and single lines; kind is ``text``, ``item`` (a line that stands for itself) or ``broken``; whether it is laid out."""
    block: list[str] = []

    def flush() -> Iterator[tuple[str, str, bool]]:
        if len(block) == 1 or block and not _wrapped(block):
            yield from ((x, "item", bool(_INDEX.search(x))) for x in block)
        elif block:
            unit = " ".join(block)
            yield unit, "text", bool(_INDEX.search(unit))
        block.clear()

    for line in text.split("\n"):
        plain = line[_MARK.match(line).end():].strip()
        if not plain:
            yield from flush()
        elif (stamp := _STAMP.match(plain)) or (columns := _COLUMNS.search(plain)) or _TIGHT_COMMA.search(plain):
            yield from flush()
            yield plain, "broken", bool(stamp or columns or _INDEX.search(plain) or len(_TIGHT_COMMA.findall(plain)) >= 2)
        elif len(plain) > WIDEST:
            yield from flush()
            yield plain, "text", bool(_INDEX.search(plain))
        else:
            block.append(plain)
            if plain.endswith(":") and plain.count(" ") >= 4 and not _CODE.search(plain):  # what it announces is a block of its own
                yield from flush()
    yield from flush()


#: Bits of each counter in a token's number.
_WIDTH = 40
_LETTERS, _LENGTH, _WORDLIKE, _OPAQUE, _NAMES, _STOPS, _EMPTY, _SHARED = (k * _WIDTH for k in range(8))
_MASK = (1 << _WIDTH) - 1


class Words(dict):
    """What is to be known of a token, as one number in which each counter has its own bits.

    The numbers of many tokens add up to all their counts at once: tokens with
    letters, letters, tokens like words, opaque ones, names, ones ending in a
    stop, ones of signs only, and common words of each language in the order
    of `languages`. Each distinct token is looked up once.
    """

    #: Distinct tokens remembered at a time.
    ROOM = 200_000

    def __init__(self, common: dict[str, frozenset[str]]):
        super().__init__()
        self.common, self.languages = common, sorted(common)
        self.shifts = [_SHARED + k * _WIDTH for k in range(len(self.languages))]

    def __missing__(self, token: str) -> int:
        if len(self) >= self.ROOM:
            self.clear()
        bare = _bare(token)
        word = bare.lower()
        out = (1 << _STOPS) * token.endswith(_STOP)
        if not word:
            out += 1 << _EMPTY
        else:
            if any(c.isalpha() for c in word):
                out += (1 << _LETTERS) + (len(word) << _LENGTH)
            if _WORD.match(bare) or _NAME.match(bare):
                out += 1 << _WORDLIKE
            elif not word.replace(".", "").replace(",", "").isdigit():
                out += 1 << _OPAQUE
            out += (1 << _NAMES) * ("_" in word or "/" in word)
            out += sum((word in self.common[x]) << s for x, s in zip(self.languages, self.shifts))
        self[token] = out
        return out


def statistics(text: str, common: dict[str, frozenset[str]] | Words) -> tuple[str, list[float]] | None:
    """(language, the statistics) of a text, or None if it has no visible character.

    The language is the one most of whose common words the text uses, the
    first in order among equals. Goes unit by unit, so that a long text needs
    little more memory than its longest paragraph.
    """
    text = tidy(text)
    if not text.strip():
        return None
    words = common if isinstance(common, Words) else Words(common)
    look, shifts = words.__getitem__, words.shifts
    chars = parts = n_tokens = visible = hard = 0
    long = laid_out = spoken = marked = worded = closed = total = 0
    for unit, kind, laid in units(text):
        tokens = unit.split()
        n, size = len(tokens), len(unit)
        counts = sum(map(look, tokens))
        signs = len(_HARD.findall(unit))
        shared = max([counts >> s & _MASK for s in shifts], default=0)
        names, stops = counts >> _NAMES & _MASK, counts >> _STOPS & _MASK
        # names crowd the common words out of technical sentences, which then show by the names or by their full stops
        technical = n >= 12 and 0.1 * n <= names <= 0.6 * n
        if n >= 6 and (kind != "item" or n >= 9 or unit.endswith((*_STOP, ":"))):
            long += size
        if laid:
            laid_out += size
        if (0 if technical or stops >= n / 40 else 0.05 * n) <= shared <= 0.64 * n + 2:
            spoken += size
        if signs > 0.03 * size:
            marked += size
        if (counts >> _WORDLIKE & _MASK) >= 0.7 * n and (counts >> _EMPTY & _MASK) <= 0.15 * n:
            worded += size
        if unit.endswith(_CLOSE):
            closed += size
        chars, parts, n_tokens, total = chars + size, parts + 1, n_tokens + n, total + counts
        visible += size - unit.count(" ")
        hard += signs
    letters, real = total >> _LETTERS & _MASK, n_tokens - (total >> _EMPTY & _MASK)
    shared = [total >> s & _MASK for s in shifts]
    best = max(range(len(shifts)), key=lambda k: (shared[k], -k), default=None)
    if not visible:  # nothing but marks of lists
        visible, hard = sum(not c.isspace() for c in text), len(_HARD.findall(text))
    of_text = [x / chars if chars else 0.0 for x in (long, laid_out, spoken, marked, worded, closed)]
    return "" if best is None else words.languages[best], [
        math.log1p(real),
        min((total >> _LENGTH & _MASK) / letters, 20.0) if letters else 20.0,
        hard / visible,
        len(_DIGIT.findall(text)) / visible,
        shared[best] / letters if best is not None and letters else 0.0,
        math.log1p(min(n_tokens / parts, 30.0)) if parts else 0.0,
        *of_text,
        (total >> _OPAQUE & _MASK) / real if real else 1.0,
    ]
