"""Personal data in free text (problem 1).

A linear-chain conditional random field over word-shape features labels the words of each sentence. It is
trained by gradient ascent on the conditional likelihood of a small labelled table, and decoded by Viterbi
in numpy over batches of sentences. A word's share of the scores depends only on the word, so it is computed
once per distinct word and added up by place. Digits count as one digit, so sentences that differ only in
them are decoded once per batch. What the field marks as personal data is then checked and written in one
form: mails by their parts, phones and identity numbers by their digits.

Defined results: null, empty and blank texts give no rows and stay as they are; an item found twice in a
text is one row; repeated rows are judged alike; very long texts are read whole, sentence by sentence;
look-alike, full-width and invisible characters are read as the plain ones; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granthika.llm.language import plain
from granthika.llm.pii_samples import KINDS, labelled_table

# Digits in words.
_NUMERALS = {w: str(i) for words in ("zero one two three four five six seven eight nine", "शून्य एक दो तीन चार पाँच छह सात आठ नौ", "ಸೊನ್ನೆ ಒಂದು ಎರಡು ಮೂರು ನಾಲ್ಕು ಐದು ಆರು ಏಳು ಎಂಟು ಒಂಬತ್ತು", "shunya ek do teen char paanch chhah saat aath nau") for i, w in enumerate(words.split())} | {"oh": "0", "o": "0"}
_TIMES = {"double": 2, "triple": 3}

TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Places whose words bear on a word's label and how much each counts, rounds of training, its step and regularisation.
NEAR, SCALE, ROUNDS, STEP, L2 = (-3, -2, -1, 0, 1, 2, 3), (0.5, 0.8, 1.2, 2.0, 1.0, 0.6, 0.4), 90, 0.4, 0.1
#: Occurrences in the labelled table from which on a feature counts.
LEAST = 24
#: Distinct words and sentences kept per Python worker; beyond this the tables start afresh.
CACHE_WORDS, CACHE_SENTENCES = 300_000, 100_000

_TOKEN = re.compile(r"[^\s,;:?!()\[\]\"“”|<>।॥]+|[,;:?!()\[\]\"“”|<>।॥]")
_ABBREVIATED = re.compile(r"(?:^|[-/])(?:[A-Za-z]|(?:[A-Z]\.)+[A-Z]|Rs|No|Nos|Smt|Shri|Sri|Mr|Mrs|Ms|Dr|St|H\.No|Crl\.P|O\.S|p\.a|W\.P|P\.O)\.$")
_SENTENCE_END = re.compile(r"(?<=[.?!।॥])\s+")
_HYPHENATED = re.compile(r"(?<=[^\W\d_])[-‐¬­][ \t\r]*\n[ \t]*(?=[a-z])")
_DIGIT = re.compile(r"\d")
_TITLES = re.compile(r"^(?:shri|smt|sri|mr|mrs|ms|dr|kumari|श्री|श्रीमती|सुश्री|डॉ|ಶ್ರೀ|ಶ್ರೀಮತಿ|ಡಾ)\.?\s+", re.I)
_EMAIL = re.compile(r"^[\w.+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+$")
_ID = re.compile(r"^(?:\d{12}|[A-Z]{5}\d{4}[A-Z]|[A-Z]{3}\d{7}|[A-Z]{2}\d{13}|[A-Z]\d{7})$")


def tokens(text: str) -> list[tuple[int, int]]:
    """Places of words and marks; a full stop that ends no abbreviation is a mark of its own."""
    out = []
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        t = m.group()
        if b - a > 1 and t[-1] == "." and not _ABBREVIATED.search(t):
            while b - a > 1 and text[b - 1] == ".":
                b -= 1
            out += ((a, b), (b, m.end()))
        else:
            out.append((a, b))
    return out


def _shape(w: str) -> str:
    return "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else "x" if c.isalpha() or not c.isascii() else c for c in w)


def features(word: str) -> list[str]:
    w = _DIGIT.sub("0", word)
    low, shape = w.lower(), _shape(w)
    short = re.sub(r"(.)\1+", r"\1", shape)
    out = [f"w={low}", f"c={short[:10]}"]
    digits = shape.count("0")
    if shape.isalpha() and not digits:
        out.append(f"l={'1' if len(w) == 1 else '2' if len(w) == 2 else '3' if len(w) < 5 else '5'}")
    else:
        out += [f"s={shape[:14]}", f"l={min(len(w), 14)}"]
    if digits:
        out += [f"d={min(digits, 15)}", f"dl={digits == len(w)}{min(len(w), 15)}"]
    if shape.isalpha() and not digits:
        out += ["script=" + ("latin" if w.isascii() or shape.strip("x") else "hi" if "ऀ" <= w[0] <= "ॿ" else "kn" if "ಀ" <= w[0] <= "೿" else "other")]
        out.append("cap=" + ("up" if w.isupper() and len(w) > 1 else "init" if len(w) == 1 and w.isupper() else "title" if w[0].isupper() else "low"))
    if "@" in w:
        out.append("mail")
    if re.fullmatch(r"[A-Z]\.", w):
        out.append("initial")
    if not any(c.isalnum() for c in w):
        out.append("mark")
    elif len(w) > 3 and not digits:
        out += [f"e={low[-n:]}" for n in (2, 3)]
    return out


def known_features(word: str, index: dict[str, int]) -> list[int]:
    """The features that count; a word that doesn't count by itself has the feature of new words."""
    found = features(word)
    return [index[f] for f in (*found, "cap new" if word[:1].isupper() else "new") if f in index and (f[-3:] != "new" or found[0] not in index)]


class Field:
    """The trained model: weights by place, feature and tag, and between tags."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, between: np.ndarray, first: np.ndarray) -> None:
        self.index, self.weights, self.between, self.first = index, weights, between, first
        self._words: dict[str, np.ndarray] = {}

    def scores(self, word: str) -> np.ndarray:
        """What a word adds to the scores of its neighbours: places x tags."""
        found = self._words.get(word)
        if found is None:
            if len(self._words) > CACHE_WORDS:
                self._words.clear()
            ids = known_features(word, self.index)
            found = self._words[word] = self.weights[:, ids].sum(axis=1) if ids else np.zeros((len(NEAR), len(TAGS)), np.float32)
        return found

    def decode(self, sentences: list[list[str]]) -> list[np.ndarray]:
        """The best tags of each sentence, by Viterbi over a padded batch."""
        n, longest = len(sentences), max(map(len, sentences))
        edge = max(NEAR)
        emit = np.zeros((n, longest + 2 * edge, len(TAGS)), np.float32)
        lengths = np.array([len(s) for s in sentences])
        rows = np.repeat(np.arange(n), lengths)
        places = np.concatenate([np.arange(k) for k in lengths])
        parts = np.array([self.scores(w) for s in sentences for w in s])
        for o, by in enumerate(NEAR):  # a word at place p bears on the word at p - by
            emit[rows, places + edge - by] += parts[:, o]
        emit = emit[:, edge : edge + longest]
        best = emit[:, 0] + self.first
        back = np.zeros((n, longest, len(TAGS)), np.int8)
        for t in range(1, longest):
            step = best[:, :, None] + self.between
            back[:, t] = step.argmax(axis=1)
            new = step.max(axis=1) + emit[:, t]
            best = np.where((t < lengths)[:, None], new, best)
        out = np.zeros((n, longest), np.int8)
        tag = best.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            out[:, t] = tag
            inside = t < lengths
            tag = np.where(inside & (t > 0), back[np.arange(n), t, tag], tag)
        return [out[i, :k] for i, k in enumerate(lengths)]


def _training_rows(table: list[list[tuple[str, str]]]) -> list[tuple[list[str], list[int]]]:
    rows = []
    for parts in table:
        text, kinds = "", []
        for piece, kind in parts:
            kinds += [(kind, len(text))] * len(piece)
            text += piece
        words, tags = [], []
        before = ("", -1)
        for a, b in tokens(text):
            kind = kinds[a]
            tags.append(0 if not kind[0] else TAGS.index(("I-" if kind == before else "B-") + kind[0]))
            before = kind
            words.append(_DIGIT.sub("0", text[a:b]))
        if words:
            rows.append((words, tags))
    return rows


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts the keys, where each run of equal ones starts, and the key of each run."""
    order = np.argsort(keys, kind="stable")
    found, starts = np.unique(keys[order], return_index=True)
    return order, starts, found


def _marginals(emit: np.ndarray, between: np.ndarray, first: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of tags by place, and expected pairs, of sentences sorted by falling length.

    The forward and backward vectors are scaled at each place, so that no logarithm is needed; `live` holds
    how many sentences reach each place.
    """
    n, longest, k = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    step, alpha, beta = np.exp(between), np.zeros_like(e), np.ones_like(e)
    alpha[:, 0] = np.exp(first) * e[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    scale = np.ones((n, longest, 1), np.float32)
    for t in range(1, longest):
        m = live[t]
        x = (alpha[:m, t - 1] @ step) * e[:m, t]
        scale[:m, t] = x.sum(axis=1, keepdims=True)
        alpha[:m, t] = x / scale[:m, t]
    pair = np.zeros((k, k), np.float32)
    for t in range(longest - 1, 0, -1):
        m = live[t]
        ahead = e[:m, t] * beta[:m, t] / scale[:m, t]
        beta[:m, t - 1] = ahead @ step.T
        pair += alpha[:m, t - 1].T @ ahead
    return alpha * beta, pair * step


def train(table: list[list[tuple[str, str]]] | None = None) -> Field:
    """The field of a labelled table, by default the whole of ours: full-batch gradient ascent with adaptive steps."""
    return _whole() if table is None else _train(table)


@lru_cache(maxsize=1)
def _whole() -> Field:
    return _train(labelled_table())


def _train(table: list[list[tuple[str, str]]]) -> Field:
    rows = sorted(_training_rows(table), key=lambda r: -len(r[0]))
    vocabulary = sorted({w for words, _ in rows for w in words})
    # A word is known by itself if it occurs outside personal data, or often; else by its shape, as new words are.
    of_word = {w: features(w) for w in vocabulary}
    seen: Counter = Counter()
    for words, tags in rows:
        for w, tag in zip(words, tags, strict=True):
            # How a word ends counts by what it ends outside personal data: names aren't told by their syllables.
            seen.update(f for f in of_word[w] if not tag or f[:2] != "e=")
            if not tag:
                seen[of_word[w][0]] += LEAST // 3
    index = {"new": 0, "cap new": 1}
    for f, n in sorted(seen.items()):
        if n >= LEAST:
            index[f] = len(index)
    of = [known_features(w, index) for w in vocabulary]
    width, none, at, k = max(map(len, of)), len(index), {w: i for i, w in enumerate(vocabulary)}, len(TAGS)
    feats = np.array([x + [none] * (width - len(x)) for x in of])
    edge, pad = max(NEAR), len(vocabulary)
    # Blocks of rows of like length, so that little is computed for places beyond a row's end.
    blocks = []
    for i in range(0, len(rows), 512):
        part = rows[i : i + 512]
        n, longest = len(part), len(part[0][0])
        ids, gold = np.full((n, longest + 2 * edge), pad), np.zeros((n, longest), int)
        for j, (words, tags) in enumerate(part):
            ids[j, edge : edge + len(words)] = [at[w] for w in words]
            gold[j, : len(tags)] = tags
        length = np.array([len(w) for w, _ in part])
        mask = np.arange(longest) < length[:, None]
        blocks.append((ids, gold, mask, [int((length > t).sum()) for t in range(longest)]))
    inside = [np.concatenate([ids[:, edge + by : edge + by + m.shape[1]][m] for ids, _, m, _ in blocks]) for by in NEAR]
    one = np.eye(k, dtype=np.float32)
    gold_one = np.concatenate([one[g[m]] for _, g, m, _ in blocks])
    gold_between, gold_first = np.zeros((k, k), np.float32), np.zeros(k, np.float32)
    for _, g, m, _ in blocks:
        np.add.at(gold_between, (g[:, :-1][m[:, 1:]], g[:, 1:][m[:, 1:]]), 1)
        gold_first += one[g[:, 0]].sum(axis=0)
    weights, between, first = np.zeros((len(NEAR), none + 1, k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32)
    sums = [np.full_like(x, 1e-8) for x in (weights, between, first)]
    scale = np.array(SCALE, np.float32)[:, None, None]
    # Sums by word and by feature, as sorted runs.
    by_word = [_runs(x) for x in inside]
    f_order, f_starts, f_ids = _runs(feats.reshape(-1))
    f_rows = f_order // width
    def told(o: int) -> np.ndarray:
        """What each word's neighbour at one place adds to its scores."""
        share = np.zeros((pad + 1, k), np.float32)
        for j in range(width):
            share[:pad] += weights[o, feats[:, j]]
        share *= SCALE[o]
        return share[inside[o]]

    def learned(o: int) -> np.ndarray:
        order, starts, words = by_word[o]
        share, g = np.zeros((pad + 1, k), np.float32), np.zeros((none + 1, k), np.float32)
        share[words] = np.add.reduceat(d[order], starts) * SCALE[o]
        g[f_ids] = np.add.reduceat(share[f_rows], f_starts)
        g[none] = 0
        return g

    with ThreadPoolExecutor(len(NEAR)) as pool:  # numpy lets the places be worked out side by side
        for _ in range(ROUNDS):
            emit = sum(pool.map(told, range(len(NEAR))))
            d, pair, g_first, from_ = np.empty_like(emit), np.zeros((k, k), np.float32), gold_first.copy(), 0
            for ids, _, mask, live in blocks:
                n = int(mask.sum())
                full = np.zeros((*mask.shape, k), np.float32)
                full[mask] = emit[from_ : from_ + n]
                prob, pairs = _marginals(full, between, first, live)
                pair += pairs
                g_first -= prob[:, 0].sum(axis=0)
                d[from_ : from_ + n] = gold_one[from_ : from_ + n] - prob[mask]
                from_ += n
            g_weights = np.array(list(pool.map(learned, range(len(NEAR)))))
            for x, g, s in zip((weights, between, first), (g_weights - L2 * weights, gold_between - pair - L2 * between, g_first), sums, strict=True):
                s += g * g
                x += STEP * g / np.sqrt(s)
    # An I- tag follows only its own kind; this is no matter of weights.
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            for i, before in enumerate(TAGS):
                if before[2:] != tag[2:]:
                    between[i, j] = -1e4
            first[j] = -1e4
    return Field(index, weights[:, :none] * scale, between, first)


def sentences(text: str, wrapped: bool) -> list[tuple[int, int]]:
    """Places of sentences. In wrapped text a line end is a space where the line goes on."""
    out = []
    for a, b in _paragraphs(text, wrapped):
        start = a
        for m in _SENTENCE_END.finditer(text, a, b):
            head = text[max(start, m.start() - 12) : m.start()]
            word = head.rsplit(None, 1)[-1] if head.split() else ""
            if text[m.start() - 1] == "." and _ABBREVIATED.search(word):
                continue
            out.append((start, m.start()))
            start = m.end()
        if start < b:
            out.append((start, b))
    return out


def _paragraphs(text: str, wrapped: bool) -> list[tuple[int, int]]:
    out, start, at = [], 0, 0
    lines = text.split("\n")
    for n, line in enumerate(lines):
        end = at + len(line)
        nxt = lines[n + 1] if n + 1 < len(lines) else ""
        bare = line.strip()
        goes_on = wrapped and bare and nxt.strip() and (bare[-1] in ",-" or nxt.strip()[:1].islower() or len(bare) >= 40)
        if not goes_on:
            if text[start:end].strip():
                out.append((start, end))
            start = end + 1
        at = end + 1
    return out


def _email(span: str) -> str | None:
    s = span.lower().strip("<>().,;: ")
    if "@" in s:  # words marked beside an ordinary mail aren't part of it
        s = next(w for w in s.split() if "@" in w).strip("<>().,;: ")
    if "@" not in s:
        s = re.sub(r"\s*[\[(]?\bat\b[\])]?\s*", "@", s, count=1)
    s = re.sub(r"\s*[\[(]?\bdot\b[\])]?\s*", ".", s)
    s = re.sub(r"\s+", "", s)
    return s if _EMAIL.match(s) else None


def _ascii_digits(span: str) -> str:
    """The digits of a span, in figures of any script or in words."""
    if any(c.isdigit() for c in span):
        return "".join(str(int(c)) for c in span if c.isdigit())
    out, times = [], 1
    for w in re.split(r"[\s,.-]+", span.lower()):
        if w in _TIMES:
            times = _TIMES[w]
        elif w in _NUMERALS:
            out.append(_NUMERALS[w] * times)
            times = 1
    return "".join(out)


def value(kind: str, span: str) -> str | None:
    """The one form of an item, or None where the exact check fails."""
    if kind == "email":
        return _email(span)
    if kind == "phone":
        d = _ascii_digits(span)
        return d[-10:] if 10 <= len(d) <= 14 and d[-10] in "6789" and (len(d) == 10 or d[:-10] in ("0", "91", "091", "0091")) else None
    if kind == "id_number":
        s = "".join(str(int(c)) if c.isdigit() else c.upper() for c in span if c.isalnum() and (c.isdigit() or c.isascii()))
        return s if _ID.match(s) else None
    if kind == "name":
        s = re.sub(r"\s+", " ", span.strip(" ,;:()\"'")).strip()
        while (t := _TITLES.sub("", s)) != s:
            s = t
        s = s.lower()
        return s if len(s) > 2 and not any(c.isdigit() for c in s) and "@" not in s else None
    # An address has a number, names something, and has a part after a comma.
    return "" if "," in span and any(c.isdigit() for c in span) and len(span.split()) >= 3 and len(re.findall(r"[^\W\d_]", span)) >= 4 else None


_known: dict[str, list[tuple[str, int, int]]] = {}


def _spans(field: Field, distinct: list[str]) -> None:
    """Decode sentences and keep the places of their marked spans."""
    split = [(s, tokens(s)) for s in distinct]
    split.sort(key=lambda x: len(x[1]))
    for i in range(0, len(split), 512):
        part = [x for x in split[i : i + 512] if x[1]]
        if not part:
            continue
        for (s, places), tags in zip(part, field.decode([[s[a:b] for a, b in places] for s, places in part]), strict=True):
            out = []
            if tags.any():
                for (a, b), tag in zip(places, tags.tolist(), strict=True):
                    if tag:
                        name = TAGS[tag]
                        if name[0] == "B":
                            out.append((name[2:], a, b))
                        else:
                            out[-1] = (out[-1][0], out[-1][1], b)
            _known[s] = out


def prepare(text: str, wrapped: bool) -> str:
    text = plain(text)
    return _HYPHENATED.sub("", text) if wrapped else text


def find(field: Field, texts: list[str], wrapped: bool) -> list[tuple[str, list[tuple[str, str, int, int]]]]:
    """For each text its plain form and the items (kind, value, start, end) in it."""
    ready = [prepare(t, wrapped) for t in texts]
    cut = [[(a, b, _DIGIT.sub("0", t[a:b].replace("\n", " "))) for a, b in sentences(t, wrapped)] for t in ready]
    if len(_known) > CACHE_SENTENCES:
        _known.clear()
    _spans(field, list({s for row in cut for _, _, s in row if s not in _known}))
    out = []
    for t, row in zip(ready, cut, strict=True):
        items = []
        for a, _, s in row:
            for kind, x, y in _known.get(s, ()):
                span = t[a + x : a + y].replace("\n", " ")
                v = value(kind, span)
                if v is not None:
                    items.append((kind, v, a + x, a + y))
        out.append((t, items))
    return out


def places(text: str, wrapped: bool) -> tuple[str, list[tuple[int, int]]]:
    """The plain form of a text by clusters of a letter and its marks, and where each of its characters comes from."""
    out, at, i = [], [], 0
    while i < len(text):
        j = i + 1
        while j < len(text) and unicodedata.category(text[j])[0] == "M":
            j += 1
        for c in plain(text[i:j]):
            out.append(c)
            at.append((i, j))
        i = j
    folded = "".join(out)
    if wrapped:
        for m in reversed(list(_HYPHENATED.finditer(folded))):
            folded = folded[: m.start()] + folded[m.end() :]
            del at[m.start() : m.end()]
    return folded, at


def _task(model, redact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = _field(model)
        for batch in batches:
            src, ids, texts = (batch.column(i).to_pylist() for i in range(3))
            for wrapped in (False, True):
                at = [i for i, s in enumerate(src) if texts[i] and (s == "analyze_text_requests") == wrapped]
                if redact and not wrapped:
                    blank = [i for i, t in enumerate(texts) if not t]
                    if blank:
                        yield _rows([(src[i], ids[i], texts[i]) for i in blank], redact)
                if at:
                    rows: list[tuple] = []
                    for i, (folded, items) in zip(at, find(field, [texts[i] for i in at], wrapped), strict=True):
                        if redact:
                            rows.append((src[i], ids[i], _replaced(texts[i], folded, items, wrapped) if items else texts[i]))
                        else:
                            rows.extend((src[i], ids[i], k, v) for k, v in {(k, v) for k, v, _, _ in items})
                    if rows:
                        yield _rows(rows, redact)

    return run


def _replaced(text: str, folded: str, items: list[tuple[str, str, int, int]], wrapped: bool) -> str:
    """The text as it was written, with placeholders for the items; all other characters stay as they are."""
    if folded != text:
        own, at = places(text, wrapped)
        if own != folded:  # clusters that fold only together: the plain form is what the places refer to
            text, at = folded, [(i, i + 1) for i in range(len(folded))]
    else:
        at = [(i, i + 1) for i in range(len(text))]
    for kind, _, a, b in sorted(items, key=lambda x: -x[2]):
        text = f"{text[: at[a][0]]}[{kind.upper()}]{text[at[b - 1][1] :]}"
    return text


def _rows(rows: list[tuple], redact: bool) -> pa.RecordBatch:
    names = ["src", "row_id", "text"] if redact else ["src", "row_id", "kind", "value"]
    types = [pa.string(), pa.int64()] + [pa.string()] * (len(names) - 2)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


_FIELDS: dict[int, Field] = {}


def _field(model) -> Field:
    """The model of this worker; broadcast once, its word table shared by all tasks of the worker."""
    key, broadcast = model
    if key not in _FIELDS:
        _FIELDS.clear()
        _FIELDS[key] = broadcast.value
    return _FIELDS[key]


def _texts(messages: DataFrame, requests: DataFrame) -> DataFrame:
    chat = messages.select(F.lit("chat_messages").alias("src"), messages["id"].cast("bigint").alias("row_id"), messages["text"].alias("text"))
    return chat.unionAll(requests.select(F.lit("analyze_text_requests").alias("src"), requests["request_id"].cast("bigint").alias("row_id"), requests["text"].alias("text")))


def _model(df: DataFrame) -> tuple:
    broadcast = df.sparkSession.sparkContext.broadcast(train())
    return id(broadcast), broadcast


def found(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """src, row_id, kind and value of the distinct items of each text. Map-side only: no shuffle."""
    texts = _texts(messages, requests).where(F.col("text").isNotNull())
    return texts.mapInArrow(_task(_model(texts), False), "src string, row_id bigint, kind string, value string")


def redacted(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """src, row_id and the text with typed placeholders in place of personal data."""
    texts = _texts(messages, requests)
    return texts.mapInArrow(_task(_model(texts), True), "src string, row_id bigint, text string")
