"""Noise in text from scanned pages (problem 3).

Spark counts words, word pairs and furniture lines over all texts. Words that occur often enough form a
trie. A word outside it is read by a Levenshtein automaton that walks the trie: confusions of the scanner
(rn for m, 1 for l, c for e, ...) cost little, other edits much, and every word of the vocabulary within
the budget is found. Candidates are ranked by cost, by the words beside them and by frequency. Page
furniture is found by its form and by its regular return, then removed, and the lines are joined into
paragraphs; a word broken by the line end is joined unless its hyphenated form is the commoner one.

Counts whose number stays below HELD are handed to every task whole. Beyond it nothing is cut off: texts then
ask their questions (is this line furniture, how often does this word occur, what does this word mean here)
as rows, the questions meet the counts by joins, and candidates are searched in tries of one length and first
letter each. Both ways give the same results.

Defined results: null, empty and blank texts have no findings and stay as they are; lines are split at
\\n and counted from 1, a \\r before it is outer white space; ties between candidates go to the more
frequent, then the smaller word; a repeated text is judged alike; very long texts are read whole, line by
line; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granthika.sources.tables import cut

#: Least occurrences of a word of the vocabulary, and how much more frequent a correction must be.
MIN_COUNT, RATIO = 4, 8
#: Words, word pairs and furniture lines that are handed to every task; more of them are met by joins.
HELD = 400_000
#: Costs of the automaton: a confusion, any other edit, and the budget of a word.
CONFUSION, EDIT, BUDGET = 0.3, 0.9, 0.95

# What a scanner writes for what is printed.
CONFUSIONS = (
    ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("l", "i"), ("i", "l"), ("0", "o"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("q", "g"),
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"), ("u", "n"), ("n", "u"), ("v", "y"), ("y", "v"), ("a", "o"), ("o", "a"), ("$", "s"), ("@", "a"), ("2", "z"),
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("vv", "w"), ("w", "vv"), ("ri", "n"), ("n", "ri"), ("li", "h"), ("h", "li"), ("nn", "m"), ("lc", "k"), ("ll", "u"), ("in", "m"), ("iu", "m"),
)
#: For a letter: 1 or the letter that must follow it, and what both together stand for.
_FROM: dict[str, list[tuple[int | str, str]]] = {}
for _a, _b in CONFUSIONS:
    _FROM.setdefault(_a[0], []).append((1 if len(_a) == 1 else _a[1], _b))

_OUTER = " \t\r\f\v.,;:!?()[]{}\"'“”‘’।|*_—–"
_WORD = re.compile(r"^[a-zà-ɏ]+(?:[-'][a-zà-ɏ]+)*$")
_LETTERS = re.compile(r"[A-Za-zÀ-ɏ]")
_BREAK = "-‐¬­"
_SUM = re.compile(r"^(?:[₹tTrRzZ?F7]|R5\.?|Rs\.?)?\s?((?:[\dOolISB]{1,2},)(?:[\dOolISB]{2},)*[\dOolISB]{3})(/-)?$")
_GROUPED = re.compile(r"^(?:\d{1,2},)(?:\d{2},)*\d{3}$")
_AS_DIGIT = str.maketrans("OolISB", "001158")

_NUMBER = r"(\d{1,4})"
_MARKS = tuple(
    re.compile(p, re.I)
    for p in (
        r"^[-–—=\s]*(?:page|pg\.?|p\.|पृष्ठ|पेज|पृ\.?|ಪುಟ)\s*(?:no\.?|सं\.?|ಸಂಖ್ಯೆ)?\s*[:.-]?\s*" + _NUMBER + r"(?:\s*(?:of|/|का|ರಲ್ಲಿ)\s*\d{1,4})?[-–—=\s]*$",
        r"^[\[({<]\s*" + _NUMBER + r"\s*[\])}>]$", r"^[-–—~*]+\s*" + _NUMBER + r"\s*[-–—~*]+$", r"^" + _NUMBER + r"\s*\|\s*p\s*a\s*g\s*e$", r"^" + _NUMBER + r"\s*/\s*\d{1,4}$",
    )
)
_OF = re.compile(r"^(\d{1,4})\s*/\s*(\d{1,4})$")
_BARE = re.compile(r"^\d{1,3}$")
_ROMAN = re.compile(r"^(?=[ivxl])(?:xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
_WITH_PAGE = re.compile(r"[\s|,;:·–—-]*(?:(?:page|pg\.?|p\.|पृष्ठ|ಪುಟ)\s*)?#+\s*$")
_END_PAGE = re.compile(r"[\s|,;:·–—-]*(?:page|pg\.?|p\.|पृष्ठ|ಪುಟ)\s*\d+\s*$", re.I)
_DIGIT, _DIGITS = re.compile(r"\d"), re.compile(r"#+")
_IN_WORD = re.compile(r"(?<=[a-z])[015]|[015](?=[a-z])")
_AS_LETTER = str.maketrans("015", "ols")
_FOLD = (("rn", "m"), ("nn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("li", "h"))
_FOLD_ONE = (("1", "i"), ("l", "i"), ("!", "i"), ("|", "i"), ("0", "o"), ("5", "s"), ("c", "e"), ("f", "t"), ("b", "h"))


def skeleton(line: str) -> str:
    """A line without case, spaces, the values of digits, an ending page number, and scanner confusions."""
    s = line.strip().lower()
    if _DIGIT.search(s):
        s = _DIGIT.sub("#", _IN_WORD.sub(lambda m: m.group().translate(_AS_LETTER), s))
        s = _DIGITS.sub("#", _WITH_PAGE.sub("", s) or s)
    for a, b in _FOLD:
        if a in s:
            s = s.replace(a, b)
    for a, b in _FOLD_ONE:
        if a in s:
            s = s.replace(a, b)
    return "".join(s.split())


def _value(digits: str) -> int:
    return int(digits)  # int reads the digits of any script


def _roman(s: str) -> int:
    v = {"i": 1, "v": 5, "x": 10, "l": 50}
    n = [v[c] for c in s]
    return sum(-a if i + 1 < len(n) and a < n[i + 1] else a for i, a in enumerate(n))


def page_marks(lines: list[str]) -> dict[int, bool]:
    """Lines with only a page mark: True where the form alone shows it, False where neighbours must."""
    out, bare = {}, {}
    for i, s in enumerate(lines):
        if not s:
            continue
        digits = _DIGIT.search(s)
        if not digits and len(s) > 8:  # a mark has a number, and the longest Roman one has eight letters
            continue
        for p in _MARKS if digits else ():
            if m := p.match(s):
                of = _OF.match(s)
                if not of or _value(of.group(1)) <= _value(of.group(2)):
                    out[i] = True
                break
        else:
            if _BARE.match(s):
                bare[i] = ("d", _value(s))
            elif _ROMAN.match(s):
                bare[i] = ("r", _roman(s))
    lone = {i: v for i, v in bare.items() if not any(j in bare for j in (i - 1, i + 1))}
    for i, (kind, v) in lone.items():
        follows = any(k == kind and j != i and abs(v - w) >= 1 and (v - w) * (i - j) > 0 and abs(i - j) >= 8 * abs(v - w) for j, (k, w) in lone.items())
        out[i] = follows
    return out


def furniture(lines: list[str], known: frozenset[str] | set[str] = frozenset()) -> tuple[set[int], set[int], list[str]]:
    """Positions of page marks and of running headers and footers, and the skeletons that returned by themselves."""
    marks = page_marks(lines)
    sure = {i for i, ok in marks.items() if ok}
    last = len(lines) - 1
    while last > 0 and not lines[last]:
        last -= 1
    groups: dict[str, list[int]] = {}
    keys: list[str] = []
    for i, s in enumerate(lines):
        k = skeleton(s) if s and i not in sure else ""
        keys.append(k)
        if len(k) >= 4:
            groups.setdefault(k, []).append(i)
    heads: set[int] = set()
    strong: list[str] = []
    for k, at in groups.items():
        if len(at) >= 3 and not (len(set(lines[i] for i in at)) == len(at) and _BARE.match(lines[at[0]])):
            starts = [p for n, p in enumerate(at) if n == 0 or p - at[n - 1] > 2]
            gaps = [b - a for a, b in zip(starts, starts[1:])]
            if len(gaps) >= 2:
                mid = median(gaps)
                if mid >= 6 and sum(abs(g - mid * max(1, round(g / mid))) <= 2 for g in gaps) >= len(gaps) - 1:
                    heads.update(at)
                    strong.append(k)
    for _ in range(4):
        before = len(heads)
        edge = lambda i: i in sure or i in heads
        beside = lambda i: edge(i - 1) or edge(i + 1) or (i > 1 and not lines[i - 1] and edge(i - 2)) or (i < last - 1 and not lines[i + 1] and edge(i + 2))
        for k, at in groups.items():
            if at[0] in heads:
                continue
            if len(at) >= 2:
                plain = not lines[at[0]].endswith((".", "।"))
                same = len({_END_PAGE.sub("", lines[i]) for i in at}) == 1
                if all(beside(i) or i <= 1 or i >= last - 1 for i in at) and (same or k in known) or plain and at[0] <= 1 and (k in known or same and len(at) == 2 and at[1] - at[0] >= 10):
                    heads.update(at)
            elif (heads or sure) and k in known and (beside(at[0]) or at[0] <= 1 or at[0] >= last - 1):
                heads.update(at)
        if len(heads) == before:
            break
    for i, ok in marks.items():
        if not ok and (i - 1 in heads or i + 1 in heads):
            sure.add(i)
    return sure, heads - sure, strong


class Vocabulary:
    """A trie of words and the automaton that walks it."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int]) -> None:
        self.counts, self.pairs = words, pairs
        self._root: dict = {}
        for w, n in words.items():
            node = self._root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
        self._most: dict[int, int] = {}  # the count of the commonest word below each node
        self._measure()
        self._seen: dict[tuple[str, int], list[tuple[float, str]]] = {}
        self._viable: dict[str, list[tuple[float, str, int]]] = {}

    def _measure(self) -> None:
        order, stack = [], [self._root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(child for c, child in node.items() if c)
        for node in reversed(order):
            self._most[id(node)] = max((self._most[id(x)] if c else self.counts[x] for c, x in node.items()), default=0)

    def candidates(self, word: str, least: int = 0) -> list[tuple[float, str]]:
        """Every word of the vocabulary within the budget of `word` that occurs `least` times, with its cost."""
        found = self._seen.get((word, least))
        if found is None:
            if len(self._seen) > 200_000:
                self._seen.clear()
            found = self._seen[word, least] = self._walk(word, least)
        return found

    def _walk(self, word: str, least: int) -> list[tuple[float, str]]:
        """Runs the automaton: a state is (read letters of the word, cost so far) at a node of the trie.

        Only a state without any cost can afford an edit, so edits branch along the word itself; elsewhere a
        state goes on by the next letter or by its confusions alone.
        """
        n, best = len(word), {}
        stack = [(self._root, 0, 0.0)]
        while stack:
            node, j, cost = stack.pop()
            if j == n and "" in node and (w := node[""]) and self.counts[w] >= least and cost < best.get(w, 9.0):
                best[w] = cost
            steps = []
            if j < n and (child := node.get(word[j])) is not None:
                steps.append((child, j + 1, cost))
            if j < n and cost + CONFUSION <= BUDGET:
                more = cost + CONFUSION
                for length, to in _FROM.get(word[j], ()):
                    if length == 1 or word[j + 1 : j + 2] == length:
                        child = node
                        for c in to:
                            child = child.get(c) if child is not None else None
                        if child is not None:
                            steps.append((child, j + (1 if length == 1 else 2), more))
            if cost + EDIT <= BUDGET:
                if j < n:
                    stack.append((node, j + 1, cost + EDIT))
                for c, child in node.items():
                    if c:
                        steps.append((child, j, cost + EDIT))
                        if j < n and c != word[j]:
                            steps.append((child, j + 1, cost + EDIT))
            stack.extend(x for x in steps if self._most[id(x[0])] >= least)
        return [(cost, w) for w, cost in best.items()]

    def count(self, word: str) -> int:
        return self.counts.get(word, 0)

    def viable(self, token: str) -> list[tuple[float, str, int]]:
        """(cost, word, count) of the words that can be meant by a token, whatever stands beside it."""
        if len(self._viable) > 200_000:
            self._viable.clear()
        word = token.lower()
        own = self.counts.get(word, 0)
        near = self.candidates(word, RATIO * max(own, 1)) if len(word) > 1 and _LETTERS.search(word) else ()
        found = self._viable[token] = [(cost, c, self.counts[c]) for cost, c in near if can_mean(token, own, c, cost, self.counts[c])]
        return found

    def meant(self, token: str, before: str, after: str) -> str | None:
        """The word that was meant by a misread one, or None if the token is a word or can't be told."""
        found = self._viable.get(token)
        if found is None:
            found = self.viable(token)
        if not found:
            return None
        pairs = self.pairs
        return choose(token, [(cost, c, n, pairs.get((before, c), 0) + pairs.get((c, after), 0)) for cost, c, n in found])


def can_mean(token: str, own: int, c: str, cost: float, n: int) -> bool:
    """Whether a word of count n can be meant by a token that occurs `own` times: by ratios, alike at every size."""
    # A form that occurs by itself needs the majority once for each confusion.
    if c == token.lower() or n < RATIO ** (max(1, round(cost / CONFUSION)) if own else 1) * max(own, 1):
        return False
    return cost < EDIT - 1e-9 or not (len(token) < 6 or token[:1].isupper() or n < 50 * max(own, 1))


def choose(token: str, found: list[tuple[float, str, int, int]]) -> str | None:
    """The best of (cost, word, count, times beside the token's neighbours)."""
    best = min(((-(near > 0), round(cost, 3), -near, -n, c) for cost, c, n, near in found), default=None)
    if best is None or token[:1].isupper() and not any(x in "0156!|$@89" for x in token.lower()) and not best[2]:
        return None  # a name that resembles a word, with nothing beside it to support the word
    return best[4]


def core(token: str) -> str:
    return token.strip(_OUTER)


def _core_scan(token: str) -> str:
    """A token without outer punctuation; an inner or leading ! may stand for a letter and stays."""
    t = token.strip(" \t\r\f\v.,;:?()[]{}\"'“”‘’।*_—–")
    return t.rstrip("!") if t.count("!") == len(t) - len(t.rstrip("!")) else t


def read(text: str, vocabulary: Vocabulary, known: frozenset[str] | set[str]) -> tuple[list[tuple[str, int, str]], str]:
    """The findings (kind, line number, item) of a text, and the text repaired into paragraphs."""
    raw = text.split("\n")
    lines = [x.strip() for x in raw]
    marks, heads, _ = furniture(lines, known)
    found = [("page_no", i + 1, lines[i]) for i in marks] + [("header", i + 1, lines[i]) for i in heads]
    body = [i for i in range(len(lines)) if i not in marks and i not in heads]
    tokens = {i: lines[i].split() for i in body}
    words = [i for i in body if tokens[i]]
    joined: dict[int, str] = {}  # line -> the token that its last token becomes
    for n, i in enumerate(words[:-1]):
        j = words[n + 1]
        if not tokens[i]:  # its only word went to the line before
            continue
        a, b = tokens[i][-1], tokens[j][0]
        if len(a) > 1 and a[-1] in _BREAK and a[-2].isalpha() and b[0].isalpha() and (j - i == 1 or n + 1 < len(words)):
            if not _crosses_paragraph(lines, i, j, marks, heads):
                left, right = core(a[:-1]).lower(), core(b).lower()
                whole, compound = left + right, f"{left}-{right}"
                if not _is_compound(left, right, whole, compound, a[-1], vocabulary):
                    meant = vocabulary.meant(whole, "", "")
                    found.append(("hyphen", i + 1, meant or whole))
                    joined[i] = a[:-1] + b
                    tokens[j] = tokens[j][1:]
                    tokens[i][-1] = joined[i]
                else:
                    tokens[i][-1] = f"{a[:-1]}-{b}"
                    tokens[j] = tokens[j][1:]
    flat = [(i, n, t) for i in words for n, t in enumerate(tokens[i])]
    seen = [_classed(t) for _, _, t in flat]
    for at, (i, n, t) in enumerate(flat):
        _, c, item = seen[at]
        if item is None:
            if not c:
                continue
            item = vocabulary.meant(c, seen[at - 1][0] if at else "", seen[at + 1][0] if at + 1 < len(seen) else "")
            if item is None or (joined.get(i) == t and n == len(tokens[i]) - 1):
                if item is not None:
                    tokens[i][n] = _replace(t, c, item)
                continue
            tokens[i][n] = _replace(t, c, item)
        else:
            tokens[i][n] = _replace(t, _sum_part(t), item)
        found.append(("misread", i + 1, item))
    return found, _reflow(lines, body, tokens)


def _crosses_paragraph(lines: list[str], i: int, j: int, marks: set[int], heads: set[int]) -> bool:
    """Whether only blank lines, and no furniture, part two lines."""
    between = range(i + 1, j)
    return bool(between) and not any(k in marks or k in heads for k in between)


def _is_compound(left: str, right: str, whole: str, compound: str, mark: str, v: Vocabulary) -> bool:
    if mark not in "-‐":
        return False
    n_whole, n_compound, n_left, n_right = v.count(whole), v.count(compound), v.count(left), v.count(right)
    if n_whole or n_compound:
        return n_compound > n_whole
    return mark == "-" and bool(n_left and n_right)


def _misreadable(c: str) -> bool:
    digits = sum(x.isdigit() for x in c)
    return not (digits * 2 > len(c) or digits > 3 or "@" in c[1:] or "/" in c or "." in c or re.fullmatch(r"\d+[A-Za-z]", c) or re.fullmatch(r"[A-Z]{2,}[-\d]*", c) or c.startswith("<"))


def _sum_part(token: str) -> str:
    return token.strip(" \t\r.,;:!()[]\"'“”।").removesuffix("/-").rstrip(".,")


def _amount(token: str) -> str | None:
    """A sum with misrecognised characters as it was meant."""
    t = _sum_part(token)
    m = _SUM.match(t)
    if not m:
        return None
    value = m.group(1).translate(_AS_DIGIT)
    if not _GROUPED.match(value):
        return None
    sign = t[: m.start(1)].strip()
    if value == m.group(1) and (sign in ("", "₹", "Rs.", "Rs")):
        return None
    if sign == "" and value == m.group(1):
        return None
    return "₹" + value


def _replace(token: str, old: str, new: str) -> str:
    if old[:1].isupper() and new[:1].islower():
        new = new[:1].upper() + new[1:]
    return token.replace(old, new, 1)


def _reflow(lines: list[str], body: list[int], tokens: dict[int, list[str]]) -> str:
    out: list[list[str]] = [[]]
    for i in body:
        if not lines[i]:
            # A blank line inside a sentence is the trace of a page end.
            if out[-1] and out[-1][-1].rstrip("\"”’)")[-1:] in ".?!।:" or out[-1] and i + 1 in tokens and tokens.get(i + 1) and not tokens[i + 1][0][:1].islower():
                out.append([])
        else:
            out[-1].extend(tokens[i])
    return "\n\n".join(" ".join(p) for p in out if p)


@lru_cache(maxsize=300_000)
def _classed(token: str) -> tuple[str, str, str | None]:
    """The plain word of a token, the form that may be misread (empty if none), and the sum that was meant."""
    item, c = _amount(token), _core_scan(token)
    return core(token).lower(), c if item is None and c.isascii() and _misreadable(c) else "", item


@lru_cache(maxsize=300_000)
def _plain_word(token: str) -> str | None:
    """The counted form of a token: empty for what isn't a word, None for what shows nothing."""
    t = core(token).lower()
    return (t if _WORD.match(t) else "") if t else None


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (w), word pairs (p) and furniture lines that return within one text (l)."""
    for batch in batches:
        words: Counter = Counter()
        pairs: Counter = Counter()
        heads: Counter = Counter()
        for text in batch.column(0).to_pylist():
            toks = [t for t in map(_plain_word, text.split()) if t is not None]
            words.update(toks)
            pairs.update(zip(toks, toks[1:]))
            if text.count("\n") >= 12:  # a line that returns twice at six lines or more needs thirteen lines
                heads.update(set(furniture([x.strip() for x in text.split("\n")])[2]))
        del words[""]
        rows = [("w", w, n) for w, n in words.items()] + [("p", f"{a} {b}", n) for (a, b), n in pairs.items() if a and b] + [("l", k, n) for k, n in heads.items()]
        yield _batch(rows, ["kind", "item", "n"], (pa.string(), pa.string(), pa.int64()))


def _batch(rows: list[tuple], names: list[str], types: tuple) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def counts(requests: DataFrame, text: str = "text") -> DataFrame:
    """kind, item and n of the words, word pairs and furniture lines that occur often enough in all texts; partial in every batch."""
    counted = requests.select(requests[text].alias("text")).where(F.col("text").isNotNull()).mapInArrow(_gather, "kind string, item string, n bigint")
    return counted.groupBy("kind", "item").agg(F.sum("n").alias("n")).where((F.col("n") >= MIN_COUNT) | (F.col("kind") == "l") & (F.col("n") >= 2))


def held(counted: DataFrame) -> tuple[dict[str, int], dict[tuple[str, str], int], frozenset[str]]:
    """All counts as they reach every task; only for counts of a checked number of rows."""
    by: dict[str, dict[str, int]] = {"w": {}, "p": {}, "l": {}}
    for r in counted.collect():
        by[r.kind][r.item] = r.n
    return by["w"], {tuple(k.split(" ")): n for k, n in by["p"].items()}, frozenset(by["l"])


_OUT = "request_id bigint, kind string, line_no int, item string"
_TYPES = {True: (pa.int64(), pa.string(), pa.int32(), pa.string()), False: (pa.int64(), pa.string())}
_NAMES = {True: ["request_id", "kind", "line_no", "item"], False: ["request_id", "text"]}


def _task(model, findings: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known = _vocabulary(model)
        for batch in batches:
            rows = []
            for request_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is not None and text.strip():
                    items, repaired = read(text, v, known)
                    rows.extend((request_id, *x) for x in items) if findings else rows.append((request_id, repaired))
                elif not findings:
                    rows.append((request_id, text))
            yield _batch(rows, _NAMES[findings], _TYPES[findings])

    return run


_MODELS: dict[int, tuple] = {}


def _vocabulary(model) -> tuple[Vocabulary, frozenset[str]]:
    """The trie, built once in each Python worker."""
    if model.id not in _MODELS:
        _MODELS.clear()
        words, pairs, known = model.value
        _MODELS[model.id] = (Vocabulary(words, pairs), known)
    return _MODELS[model.id]


class Model:
    """A broadcast of the counts with an id that survives pickling."""

    def __init__(self, spark, fitted) -> None:
        self._b = spark.sparkContext.broadcast(fitted)
        self.id = id(self._b)

    @property
    def value(self):
        return self._b.value


# The other way: questions and answers as rows.


class Answers:
    """What one text has been told; what it asks beyond that is noted and answered as if nothing were known."""

    def __init__(self, told: list[tuple[str, str, str | None]]) -> None:
        self.known = {q for kind, q, _ in told if kind == "l"}
        self._counts = {q: int(a) for kind, q, a in told if kind == "c"}
        self._meant = {q: a for kind, q, a in told if kind == "m"}
        self.asked: set[tuple[str, str]] = set()

    def count(self, word: str) -> int:
        self.asked.add(("c", word))
        return self._counts.get(word, 0)

    def meant(self, token: str, before: str, after: str) -> str | None:
        if len(token) < 2 or not _LETTERS.search(token):
            return None
        question = f"{token}\x1f{before}\x1f{after}"
        self.asked.add(("m", question))
        return self._meant.get(question)


_TOLD = "key string, text string, told array<struct<kind:string,question:string,answer:string>>"


def _told(batch: pa.RecordBatch) -> Iterator[tuple[str, str, list[tuple]]]:
    for key, text, told in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
        yield key, text, [(x["kind"], x["question"], x["answer"]) for x in told or ()]


def _asking(kind: str):
    """The questions of a kind that each text has, given what it was told before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, told in _told(batch):
                if kind == "l":
                    asked = {("l", k) for x in text.split("\n") if len(k := skeleton(x)) >= 4}
                else:
                    answers = Answers(told)
                    read(text, answers, answers.known)
                    asked = answers.asked
                rows.extend((key, q) for k, q in asked if k == kind)
            yield _batch(rows, ["key", "question"], (pa.string(), pa.string()))

    return run


def _ending(findings: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, told in _told(batch):
                answers = Answers(told)
                items, repaired = read(text, answers, answers.known)
                rows.extend((key, *x) for x in items) if findings else rows.append((key, repaired))
            yield _batch(rows, ["key", *_NAMES[findings][1:]], (pa.string(), *_TYPES[findings][1:]))

    return run


def _firsts(word: str) -> list[str]:
    """First letters that a word within the budget can have, if no whole edit lies at the front."""
    return sorted({word[0]} | {b[0] for a, b in CONFUSIONS if word.startswith(a)})


def _routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(w, n, size, c) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for size in range(max(1, len(w) - 3), len(w) + 4) for c in _firsts(w)]
        yield _batch(rows, ["word", "own", "size", "first"], (pa.string(), pa.int64(), pa.int32(), pa.string()))


def _walk_group(asked: pa.Table, words: pa.Table) -> pa.Table:
    """Every word of one trie within the budget of each asked word."""
    trie = Vocabulary(dict(zip(words["item"].to_pylist(), words["n"].to_pylist(), strict=True)), {})
    rows = [(w, own, c, cost, trie.counts[c]) for w, own in zip(asked["word"].to_pylist(), asked["own"].to_pylist(), strict=True) for cost, c in trie._walk(w, RATIO * max(own, 1))]
    return pa.Table.from_batches([_batch(rows, ["word", "own", "c", "cost", "n"], (pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int64()))])


def candidates(asked: DataFrame, words: DataFrame) -> DataFrame:
    """word, own, c, cost, n: for each asked word (word, own) every counted word (item, n) within the budget.

    Words lie in tries of one length and first letter. An asked word visits the tries that its confusions can
    reach; an edit at its front uses up the budget, so those words equal it behind the front and meet it there.
    """
    routed = asked.mapInArrow(_routes, "word string, own bigint, size int, first string")
    tries = words.select("item", "n", F.length("item").alias("size"), F.substring("item", 1, 1).alias("first"))
    walked = routed.groupBy("size", "first").cogroup(tries.groupBy("size", "first")).applyInArrow(_walk_group, "word string, own bigint, c string, cost double, n bigint")
    tail = F.expr("substring(item, 2)")
    fronts = [(F.col("word"), tail), (F.expr("substring(word, 2)"), tail), (F.expr("substring(word, 2)"), F.col("item"))]
    for mine, theirs in fronts:
        met = asked.select("word", "own", mine.alias("k")).join(words.select("item", "n", theirs.alias("k")), "k")
        walked = walked.unionAll(met.where("item <> word").select("word", "own", F.col("item").alias("c"), F.lit(EDIT).alias("cost"), "n"))
    return walked.groupBy("word", "own", "c", "n").agg(F.min("cost").alias("cost"))


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for question, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows.append((question, choose(question.split("\x1f")[0], [(x["cost"], x["c"], x["n"], x["near"]) for x in found])))
        yield _batch([r for r in rows if r[1] is not None], ["question", "answer"], (pa.string(), pa.string()))


def _meanings(questions: DataFrame, words: DataFrame, pairs: DataFrame) -> DataFrame:
    """question and answer of what tokens mean beside their neighbours; without a row where nothing is meant."""
    part = F.split("question", "\x1f")
    q = questions.select("question").distinct().select("question", part[0].alias("token"), part[1].alias("before"), part[2].alias("after"))
    tokens = q.select("token").distinct().select("token", F.lower("token").alias("word")).join(words.select(F.col("item").alias("word"), F.col("n").alias("own")), "word", "left").select("token", "word", F.coalesce("own", F.lit(0)).alias("own"))
    c = cut(candidates(tokens.select("word", "own").distinct(), words))
    times = F.when(F.col("own") > 0, F.pow(F.lit(float(RATIO)), F.greatest(F.lit(1.0), F.round(F.col("cost") / CONFUSION)))).otherwise(float(RATIO))
    own, upper = F.greatest("own", F.lit(1)), F.substring("token", 1, 1).rlike(r"\p{Lu}")
    viable = tokens.join(c, ["word", "own"]).where((F.col("c") != F.col("word")) & (F.col("n") >= times * own) & ((F.col("cost") < EDIT - 1e-9) | ~((F.length("token") < 6) | upper | (F.col("n") < 50 * own))))
    met = q.join(viable.select("token", "c", "cost", "n"), "token")
    near = pairs.select(F.col("item").alias("pair"), F.col("n").alias("times"))
    for side in (F.concat_ws(" ", "before", "c"), F.concat_ws(" ", "c", "after")):
        met = met.withColumn("pair", side).join(near, "pair", "left").withColumn("near", F.coalesce("times", F.lit(0)) + (F.col("near") if "near" in met.columns else F.lit(0))).drop("pair", "times")
    grouped = met.groupBy("question").agg(F.collect_list(F.struct("cost", "c", "n", "near")).alias("found"))
    return grouped.mapInArrow(_choices, "question string, answer string")


def _by_questions(requests: DataFrame, counted: DataFrame, findings: bool) -> DataFrame:
    """The same as with counts at hand, for any number of counts: four passes over the distinct texts."""
    counted = cut(counted)
    words, pairs, lines = (counted.where(F.col("kind") == k).select("item", "n") for k in "wpl")
    keyed = requests.select(F.col("request_id").cast("bigint").alias("request_id"), "text", F.sha2("text", 256).alias("key"))
    blank = F.coalesce(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), F.lit("")) == ""
    texts = cut(keyed.where(~blank).groupBy("key").agg(F.min("text").alias("text")).withColumn("told", F.expr("cast(array() as array<struct<kind:string,question:string,answer:string>>)")))
    for kind in "lcm":
        asked = cut(texts.mapInArrow(_asking(kind), "key string, question string"))
        if kind == "m":
            answers = _meanings(asked, words, pairs)
        else:
            answers = (lines if kind == "l" else words).select(F.col("item").alias("question"), F.col("n").cast("string").alias("answer"))
        told = asked.join(answers, "question").groupBy("key").agg(F.collect_list(F.struct(F.lit(kind).alias("kind"), "question", "answer")).alias("more"))
        texts = cut(texts.join(told, "key", "left").select("key", "text", F.concat("told", F.coalesce("more", F.expr("cast(array() as array<struct<kind:string,question:string,answer:string>>)"))).alias("told")))
    ended = texts.mapInArrow(_ending(findings), "key string, " + (_OUT if findings else "request_id bigint, text string").split(", ", 1)[1])
    if findings:
        return keyed.select("request_id", "key").join(ended, "key").select("request_id", "kind", "line_no", "item")
    done = ended.withColumnRenamed("text", "repaired").withColumn("read", F.lit(True))
    return keyed.join(done, "key", "left").select("request_id", F.when(F.col("read"), F.col("repaired")).otherwise(F.col("text")).alias("text"))


def found(requests: DataFrame, held_rows: int = HELD) -> DataFrame:
    """request_id, kind, line_no and item of every finding."""
    return _apply(requests, True, _OUT, held_rows)


def repaired(requests: DataFrame, held_rows: int = HELD) -> DataFrame:
    """request_id and the text as continuous paragraphs."""
    return _apply(requests, False, "request_id bigint, text string", held_rows)


def _apply(requests: DataFrame, findings: bool, schema: str, held_rows: int) -> DataFrame:
    counted = counts(requests).persist()
    try:
        if counted.count() > held_rows:
            return _by_questions(requests, counted, findings)
        model = Model(requests.sparkSession, held(counted))
    finally:
        counted.unpersist()
    return requests.select(F.col("request_id").cast("bigint"), "text").mapInArrow(_task(model, findings), schema)
