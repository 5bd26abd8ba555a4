"""Languages of texts and of their segments, and labels that contradict them (problem 2).

Hyperdimensional profiles: every letter has a random vector of +1 and -1, drawn from its code point. The
letters of an n-gram are permuted by their place and bound by multiplication; the n-grams of a word or of a
language's sample are bundled by addition. A word's evidence is the cosine between its vector and the
prototypes. The words of a sentence are joined into segments by the cheapest path over languages, and
neighbouring segments of one language become one. A segment that is a whole sentence makes its language one of the
text's languages; its confidence is the margin of its evidence.

Defined results: null, empty and blank texts, and texts without a word of letters (numbers, links, addresses
of mail), show nothing and have no language; ties keep the language of the words before; full-width, look-
alike and invisible characters are read as the plain ones; repeated rows count as often as they occur; very
long texts are read whole; empty tables give an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granthika.llm.conversations import clean_role
from granthika.llm.prose import MORE, PROSE
from granthika.llm.lookalike import CYRILLIC, GREEK, LATIN

LANGUAGES = ("english", "hindi", "kannada")
#: Width of the vectors, letters of an n-gram, weight of a cosine, and cost of a change of language in a sentence.
WIDTH, GRAM, WEIGHT, SWITCH = 2048, 3, 6.0, 4.0
#: Words that make a segment a whole sentence, by language.
WHOLE = {"english": 4, "hindi": 4, "kannada": 3}
CACHE_SENTENCES = 200_000

# Words without which a run of English words is no sentence (street names, titles, acts).
_ENGLISH = frozenset("the a an is are was were be been i my me we our you your he she it its they this that what which who where when how can could may shall should must do does did has have had of to in on for with at by from and or not no if but as any please".split())

# The same for Hindi in Latin letters.
_HINDI = frozenset("ka ke ki ko se mein me hai hain ne par kya nahin nahi to aur yeh ye woh wo ho hoon kar diya kiya tha the thi gaya gaye hua mera meri mere main maine hum ab jo bhi".split())

# Spellings of the language labels.
LABELS = {
    "english": ("english", "en", "eng", "en-in", "en-us", "en-gb", "en_in", "angrezi", "अंग्रेज़ी", "अंग्रेजी", "ಇಂಗ್ಲಿಷ್"),
    "hindi": ("hindi", "hi", "hin", "hi-in", "hi_in", "हिन्दी", "हिंदी", "हिंदि"),
    "kannada": ("kannada", "kn", "kan", "kn-in", "kn_in", "ಕನ್ನಡ", "कन्नड़", "कन्नड"),
}

_PLAIN = str.maketrans({c: to for other in (CYRILLIC, GREEK) for c, to in zip(other, LATIN, strict=True) if c != " "})
_UNSEEN = re.compile("[­​-‏⁠﻿]")
_MAIL = re.compile(r"\S*@\S*|https?://\S+|\S+ ?(?:\(at\)|\[at\]|\bat\b) ?\S+(?: ?(?:\(dot\)|\[dot\]|\bdot\b) ?[a-z]+)+", re.I)
_NUMBERED = re.compile(r"\S*\d\S*")
_END = re.compile(r"[?!।॥\n;]+|(?<!\b\w)(?<!\bRs)(?<!\bNo)(?<!\bMr)(?<!\bMs)(?<!\bDr)(?<!\bSt)(?<!\bMrs)(?<!\bSmt)(?<!\bShri)\.+(?=\s|$)")
_WORDS = re.compile(r"[^\W\d_]+(?:[̀-ͯऀ-ःऺ-ॏॢॣಀ-ಃ಼-ೖ‌‍'’-]+[^\W\d_]*)*")


@lru_cache(maxsize=None)
def _letter(c: str) -> np.ndarray:
    return np.random.default_rng(ord(c)).integers(0, 2, WIDTH, dtype=np.int8) * np.int8(2) - np.int8(1)


def _bundle(words: list[str]) -> np.ndarray:
    total = np.zeros(WIDTH, dtype=np.int32)
    for w in words:
        padded = f" {w} "
        for i in range(len(padded) - GRAM + 1):
            g = np.roll(_letter(padded[i]), 2)
            for k in range(1, GRAM):
                g = g * np.roll(_letter(padded[i + k]), GRAM - 1 - k)
            total += g
    return total


#: The texts from which the profiles are made, by language and script.
SAMPLES = {k: text + MORE.get(k, "") for k, text in PROSE.items()}


@lru_cache(maxsize=1)
def prototypes() -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the profiles, and the language of each; the mean of all profiles is taken out."""
    raw = []
    for text in SAMPLES.values():
        v = _bundle([w for w in re.findall(_WORDS, text.lower())]).astype(float)
        raw.append(v / np.linalg.norm(v))
    m = np.array(raw)
    latin = [i for i, (_, script) in enumerate(SAMPLES) if script == "latin"]
    m[latin] -= m[latin].mean(axis=0) * 0.5
    return m / np.linalg.norm(m, axis=1, keepdims=True), np.array([LANGUAGES.index(lang) for lang, _ in SAMPLES])


@lru_cache(maxsize=200_000)
def evidence(word: str) -> tuple[float, float, float]:
    """The cosine of a word with the nearest profile of each language."""
    m, lang = prototypes()
    v = _bundle([word]).astype(float)
    cos = m @ v / np.linalg.norm(v)
    return tuple(float(cos[lang == k].max()) for k in range(len(LANGUAGES)))  # type: ignore[return-value]


def plain(text: str) -> str:
    if text.isascii():
        return text
    return _UNSEEN.sub("", unicodedata.normalize("NFKC", text)).translate(_PLAIN)


def _path(words: list[str]) -> list[int]:
    """The cheapest language of each word of a sentence."""
    best = [0.0, 0.0, 0.0]
    back: list[list[int]] = []
    for n, w in enumerate(words):
        e = evidence(w)
        top = max(range(3), key=lambda k: best[k])
        row = [k if n == 0 or best[k] >= best[top] - SWITCH else top for k in range(3)]
        best = [best[row[k]] - (0.0 if row[k] == k else SWITCH) + WEIGHT * e[k] for k in range(3)]
        back.append(row)
    k = max(range(3), key=lambda j: best[j])
    out = [0] * len(words)
    for n in range(len(words) - 1, -1, -1):
        out[n] = k
        k = back[n][k]
    return out


_cache: dict[str, tuple] = {}


def _sentence(text: str) -> tuple[tuple[int, int, float, bool], ...]:
    """(language, words, confidence, like a sentence) of each run of a sentence.

    Names, places and acts don't bear on the language: a capital inside a sentence leaves a word out.
    Digits don't either, so sentences that differ only in them are judged once per worker.
    """
    key = re.sub(r"\d+", "0", text)
    found = _cache.get(key)
    if found is None:
        if len(_cache) > CACHE_SENTENCES:
            _cache.clear()
        words = [w.lower() for n, w in enumerate(_WORDS.findall(_NUMBERED.sub(" ", key))) if n == 0 or not w[0].isupper() or len(w) == 1]
        path = _path(words)
        runs, start = [], 0
        for n in range(1, len(words) + 1):
            if n == len(words) or path[n] != path[start]:
                run = words[start:n]
                scores = np.array([evidence(w) for w in run]).sum(axis=0) * WEIGHT
                p = np.exp(scores - scores.max())
                sure = float(p[path[start]] / p.sum())
                runs.append((path[start], len(run), sure, _sentence_like(path[start], run, sure)))
                start = n
        found = _cache[key] = tuple(runs)
    return found


def _sentence_like(language: int, run: list[str], sure: float) -> bool:
    """Whether a run has what a sentence of its language has; a script of its own is enough."""
    if language == 0:
        return any(w in _ENGLISH for w in run)
    return any(not w.isascii() for w in run) or (any(w in _HINDI for w in run) if language == 1 else sure >= 0.8)


def segments(text: str) -> list[tuple[str, int, float, bool]]:
    """(language, words, confidence, whole sentence) of each segment of a text, in order."""
    text = plain(text)
    if "@" in text or "dot" in text:
        text = _MAIL.sub(" ", text)
    out: list[list] = []
    for s in _END.split(text):
        if s:
            for lang, n, p, like in _sentence(s):
                if out and out[-1][0] == lang:
                    last = out[-1]
                    last[2] = (last[2] * last[1] + p * n) / (last[1] + n)
                    last[1] += n
                    last[3] = last[3] or like
                else:
                    out.append([lang, n, p, like])
    return [(LANGUAGES[k], n, round(p, 4), n >= WHOLE[LANGUAGES[k]] and like) for k, n, p, like in out]


def languages(text: str) -> tuple[str | None, float, list[str]]:
    """The language of a text (None if it shows none), its confidence, and the languages of whole sentences."""
    parts = segments(text)
    if not parts:
        return None, 0.0, []
    if len(parts) == 1:
        lang, _, p, whole = parts[0]
        return lang, p, [lang] if whole else []
    weight: dict[str, int] = {}
    for lang, n, _, _ in parts:
        weight[lang] = weight.get(lang, 0) + n
    top = max(weight, key=lambda k: (weight[k], k))
    confidence = sum(n * c for lang, n, c, _ in parts if lang == top) / sum(weight.values())
    return top, round(confidence, 4), sorted({lang for lang, _, _, w in parts if w})


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [languages(t) if t else (None, 0.0, []) for t in batch.column(batch.num_columns - 1).to_pylist()]
        columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "lang", "confidence", "whole"])


def labelled(messages: DataFrame) -> DataFrame:
    """id, session_id, user_id, role, lang, confidence and the languages of whole sentences of each message."""
    picked = messages.select(F.col("id").cast("bigint"), "session_id", F.col("user_id").cast("bigint"), clean_role(F.col("role")).alias("role"), "text")
    return picked.mapInArrow(_task, "id bigint, session_id string, user_id bigint, role string, lang string, confidence double, whole array<string>")


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, n, *s) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for n, s in enumerate(segments(t))]
        types = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.bool_())
        columns = zip(*rows, strict=True) if rows else [[] for _ in types]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["id", "segment", "lang", "n_words", "confidence", "whole"])


def segment_rows(messages: DataFrame) -> DataFrame:
    """One row for each segment of each message."""
    picked = messages.select(F.col("id").cast("bigint"), "text")
    return picked.mapInArrow(_segment_rows, "id bigint, segment int, lang string, n_words int, confidence double, whole boolean")


def clean_label(label: Column) -> Column:
    """The language that a label names; null where it names none."""
    x = F.lower(F.trim(label))
    out = None
    for lang, names in LABELS.items():
        hit = x.isin(*names)
        out = F.when(hit, lang) if out is None else out.when(hit, lang)
    return out


def found(users: DataFrame, conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """src, row_id and lang of wrong or missing labels, and of messages that mix languages.

    Every text is read once. Each message gives a unit for its session and one for its user, or its own
    languages if it mixes them; all are counted by one shuffle with partial sums, so that a user or session
    with very many rows sends a few numbers from each task.
    """
    one = lambda src, key, langs: F.struct(F.lit(src).alias("src"), key.cast("string").alias("row_id"), langs.alias("langs"))
    counted = (F.col("role") == "user") & F.col("lang").isNotNull() & (F.size("whole") < 2)
    units = F.array(
        F.when(counted & F.col("session_id").isNotNull(), one("conversations", F.col("session_id"), F.array("lang"))),
        F.when(counted & F.col("user_id").isNotNull(), one("users", F.col("user_id"), F.array("lang"))),
        F.when(F.size("whole") > 1, one("chat_messages", F.col("id"), F.col("whole"))),
    )
    flat = labelled(messages).select(F.explode(F.filter(units, lambda u: u.isNotNull())).alias("u"))
    sums = [F.sum(F.array_contains("u.langs", k).cast("bigint")).alias(k) for k in LANGUAGES]
    per = flat.groupBy("u.src", "u.row_id").agg(*sums)
    mixed = F.col("src") == "chat_messages"
    total = sum((F.col(k) for k in LANGUAGES[1:]), F.col(LANGUAGES[0]))
    kept = F.filter(F.array(*[F.when((F.col(k) > 0) & (mixed | (F.col(k) * 2 > total)), F.lit(k)) for k in LANGUAGES]), lambda k: k.isNotNull())
    rows = per.select("src", "row_id", F.explode(kept).alias("lang"))
    labels = conversations.select(F.lit("conversations").alias("src"), F.col("id").alias("row_id"), clean_label(F.col("language")).alias("label")).unionAll(
        users.select(F.lit("users").alias("src"), F.col("id").cast("string").alias("row_id"), clean_label(F.col("language")).alias("label"))
    )
    joined = rows.join(labels.withColumn("labelled", F.lit(True)), ["src", "row_id"], "left")
    wrong = F.col("labelled") & ~F.coalesce(F.col("label") == F.col("lang"), F.lit(False))
    return joined.where(mixed | F.coalesce(wrong, F.lit(False))).select("src", "row_id", "lang")
