"""Document languages by hyperdimensional profiles.

Every letter gets a random bipolar vector. An n-gram is bound by multiplying the
letter vectors, each permuted by its place; a text is the bundle (sum) of its
n-gram vectors, and a language prototype the bundle of its training texts. Texts
and sentences are compared with the prototypes by cosine.

A bundle is linear in its n-grams, so the dot product of a text with a prototype is
the sum of the products of its n-grams. The products of all n-grams are computed once
from the real vectors, as one matrix product, and looked up after that; the table has
a fixed size (27**4 n-grams x 6 languages, 13 MB).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import fresh

LANGUAGES = ("en", "fr", "de", "es", "it", "pt")
#: Three-letter codes and English names of the languages.
LABELS = {
    "en": ("en", "eng", "english"), "fr": ("fr", "fra", "fre", "french"), "de": ("de", "deu", "ger", "german"),
    "es": ("es", "spa", "spanish"), "it": ("it", "ita", "italian"), "pt": ("pt", "por", "portuguese"),
}
DIM = 2048
#: 4-grams of the blank and 26 letters.
GRAMS = 27**4
#: Labelled texts used for the prototype of each language.
TRAIN_PER_LANGUAGE = 3000
#: Of these, the texts whose sentences retrain the prototypes.
REFINE_PER_LANGUAGE = 300
#: What a change of language between sentences must gain.
SWITCH = 2.5
#: Characters taken of a long text for training: a stretch at a place its hash decides.
SAMPLE_CHARS, REFINE_CHARS = 20_000, 4_000
#: 4-grams below which a text has too few letters to tell.
LEAST_GRAMS = 4
#: The language of texts with too few Latin letters to tell.
UNDETERMINED = "und"
#: The longest quoted phrase that doesn't count, in characters and words, and the longest markup tag.
QUOTE_CHARS, QUOTE_WORDS, TAG_CHARS = 80, 8, 40
#: Characters and texts worked on at a time.
CHARS, TEXTS = 1_000_000, 2_000
_END, _DROP = 27, 255
_QUOTE = re.compile("[\"“”„«»]([^\"“”„«»\\n\\x00]{0,%d})[\"“”„«»]" % QUOTE_CHARS)
_BREAK = re.compile(r"[.!?…][\"')\]”»]*\s+|\n+")
_TAG = re.compile(r"<[^<>\n\x00]{0,%d}>|&[a-z]{2,8};|https?://[^\s\x00]+" % TAG_CHARS)
_ODD = re.compile("[^ \\x00]*[^\\x00-\\x7f][^ \\x00]*")


def label_language(c: Column) -> Column:
    """The language a delivered label names, with or without a region, or null."""
    base = F.regexp_extract(F.lower(F.trim(c)), "^([a-z]+)(?:[-_ (].*)?$", 1)
    table = F.create_map(*[F.lit(x) for k, names in LABELS.items() for n in names for x in (n, k)])
    return F.try_element_at(table, base)


def _code_table() -> np.ndarray:
    """Of every character up to U+1FFF: 1 to 26 for a letter without its accents, 0 for other ASCII, 27 for the end of a sentence; the rest doesn't count."""
    out = np.full(0x2001, _DROP, dtype=np.uint8)
    for i in range(0x2000):
        base = unicodedata.normalize("NFD", chr(i).lower()).encode("ascii", "ignore")
        if len(base) == 1:
            out[i] = base[0] - 96 if 97 <= base[0] <= 122 else 0
    out[0] = _END
    return out


_CODES = _code_table()


def _mended(text: str) -> str:
    """UTF-8 that was read as Latin-1 or Windows-1252, word by word."""

    def fix(m: re.Match) -> str:
        for code in ("cp1252", "latin-1"):
            try:
                return m[0].encode(code).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                pass
        return m[0]

    return _ODD.sub(fix, text)


def _plain(text: str) -> str:
    """Without markup and short quoted phrases, damage mended, ligatures spelled out."""
    if "<" in text or "&" in text or "http" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii() or '"' in text:
        text = _QUOTE.sub(lambda m: " " if len(m[1].split()) <= QUOTE_WORDS else m[0], text)
    if "Ã" in text or "Â" in text or "â€" in text:
        text = _mended(text)
    if not text.isascii():
        text = text.replace("ß", "ss").replace("œ", "oe").replace("æ", "ae").replace("Œ", "oe").replace("Æ", "ae").replace("\u2019", " ")
    return text


def sentence_grams(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams of sentences, each closed by NUL, and the number of the sentence each is of.

    A sentence is read as its words with single blanks between and around them.
    """
    code = _CODES[np.minimum(np.frombuffer(("\x00" + joined).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 0x2000)]
    code = code[code != _DROP]
    end = code == _END
    sentence = np.cumsum(end, dtype=np.int32) - 1
    blank = end | (code == 0)
    at = np.flatnonzero(~blank | np.concatenate([[True], ~blank[:-1]]))
    edge = np.logical_or.reduceat(end, at)
    c = np.where(blank[at], 0, code[at]).astype(np.int32)
    if len(c) < 4:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
    sentence = sentence[at]
    ids = ((c[:-3] * 27 + c[1:-2]) * 27 + c[2:-1]) * 27 + c[3:]
    inside = ~(edge[1:-2] | edge[2:-1])
    owner = np.where(c[1:-2] > 0, sentence[1:-2], sentence[2:-1])
    return ids[inside], owner[inside]


def _letters(text: str) -> str:
    """Lower-case Latin letters without accents, one blank between words."""
    code = _CODES[np.minimum(np.frombuffer(_plain(text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 0x2000)]
    code = code[code != _DROP]
    return " " + " ".join((np.where(code > 26, 0, code) + np.where((code > 0) & (code < 27), 96, 32)).astype(np.uint8).tobytes().decode().split()) + " "


def letter_vectors(dim: int, seed: int = 7) -> np.ndarray:
    """Random bipolar vectors of the blank and the 26 letters."""
    return np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), size=(27, dim))


def gram_ids(s: str) -> np.ndarray:
    """Ids of the 4-grams of text made of blanks and letters."""
    c = np.frombuffer(s.encode("ascii"), dtype=np.uint8)
    c = np.where(c == 32, 0, c - 96).astype(np.int64)
    if len(c) < 4:
        c = np.concatenate([c, np.zeros(4 - len(c), dtype=np.int64)])
    return ((c[:-3] * 27 + c[1:-2]) * 27 + c[2:-1]) * 27 + c[3:]


def gram_vectors(ids: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The bound vectors of 4-grams: each letter's vector rolled by its place, multiplied."""
    out = np.roll(v, 3, axis=1)[ids // 19683]
    out *= np.roll(v, 2, axis=1)[ids // 729 % 27]
    out *= np.roll(v, 1, axis=1)[ids // 27 % 27]
    out *= v[ids % 27]
    return out


def _halves(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bound vectors of all first and of all last two letters of a 4-gram."""
    pair = lambda i, j: (np.roll(v, i, axis=1)[:, None, :] * np.roll(v, j, axis=1)[None, :, :]).reshape(729, -1).astype(np.float32)
    return pair(3, 2), pair(1, 0)


def bundled(ids: np.ndarray, weight: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The weighted sum of the vectors of distinct 4-grams."""
    total = np.zeros(v.shape[1])
    for i in range(0, len(ids), 2048):
        total += weight[i : i + 2048].astype(np.float32) @ gram_vectors(ids[i : i + 2048], v).astype(np.float32)
    return total


def all_products(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Dot products of the vectors of all 4-grams with prototypes, a row for each prototype."""
    first, last = _halves(v)
    return np.stack([(first @ (last * q.astype(np.float32)).T).reshape(-1) for q in p])


def products_with(ids: np.ndarray, v: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Dot products of the vectors of 4-grams with prototypes."""
    rows = [gram_vectors(ids[i : i + 2048], v).astype(np.float32) @ p.T.astype(np.float32) for i in range(0, len(ids), 2048)]
    return np.concatenate(rows) if rows else np.zeros((0, len(p)), dtype=np.float32)


class Profiles:
    """Language prototypes and the products of all n-grams with them."""

    def __init__(self, prototypes: np.ndarray) -> None:
        p = prototypes - prototypes.mean(axis=0)  # what all languages share says nothing
        norm = np.linalg.norm(p, axis=1, keepdims=True)
        self.p = (p / np.where(norm == 0, 1, norm)).astype(np.float32)
        self.dim = prototypes.shape[1]
        self.v = letter_vectors(self.dim)
        self.table = all_products(self.v, self.p)

    def bundles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Dot products of the bundles of letters-only texts with the prototypes, and the bundles' lengths."""
        ids, owner = sentence_grams("".join(t + "\x00" for t in texts))
        some, dots, norms, _ = scored(ids, owner, self.table, self.dim)
        out, length = np.zeros((len(texts), len(self.table))), np.zeros(len(texts))
        out[some], length[some] = dots, norms
        return out, length


def scored(ids: np.ndarray, owner: np.ndarray, table: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sentences that have n-grams, their bundles' products with the prototypes, the bundles' lengths, and the numbers of n-grams.

    The n-gram vectors are quasi-orthogonal, so the length of a bundle is that of its
    counts times the root of the dimension.
    """
    start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, dtype=int)
    if not len(start):
        return start, np.zeros((0, len(table))), np.zeros(0), start
    size = np.diff(np.append(start, len(ids)))
    dots = np.array([np.add.reduceat(row[ids], start) for row in table], dtype=np.float64).reshape(len(table), len(start)).T
    key = np.sort((np.repeat(np.arange(len(start), dtype=np.uint64), size) << np.uint64(20)) | ids.astype(np.uint64))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key))).astype(np.float64)
    norm = np.sqrt(np.bincount((key[first] >> np.uint64(20)).astype(np.int64), weights=count * count, minlength=len(start)))
    return owner[start], dots, norm * dim**0.5, size


def breaks(text: str) -> list[tuple[int, int]]:
    """Begin and end of every whole sentence: cut after closing punctuation and at line ends."""
    out, at = [], 0
    for m in _BREAK.finditer(text):
        stop = m.start() + (text[m.start()] != "\n")
        if stop > at:
            out.append((at, stop))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def sentences(text: str) -> list[str]:
    """Whole sentences that are not blank."""
    return [text[a:b] for a, b in breaks(text) if text[a:b].strip()]


def _closed(text: str, spans: list[tuple[int, int]]) -> str:
    """What counts of the sentences of a text, each closed by NUL."""
    clean = text.replace("\x00", " ")
    return _plain("\x00".join(clean[a:b] for a, b in spans) + "\x00")


def gains(dots: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """What a sentence says for each language: its cosines, weighted by the root of its length."""
    return dots / np.sqrt(np.maximum(norms, 1))[:, None]


def segment(dots: np.ndarray, norms: np.ndarray, switch: float) -> np.ndarray:
    """The best language per sentence of one text when every change costs ``switch`` (Viterbi)."""
    return segments(gains(dots, norms), np.array([0]), switch)


def segments(gain: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The same for many texts, whose sentences begin at ``first``; the texts are walked side by side."""
    path = gain.argmax(axis=1).astype(np.int8)
    size = np.diff(np.append(first, len(gain)))
    # Where all sentences agree, no change can gain.
    mixed = np.flatnonzero(np.logical_or.reduceat(path != np.repeat(path[first], size), first))
    mixed = mixed[np.argsort(-size[mixed], kind="stable")]
    if not len(mixed):
        return path
    at, left = first[mixed], size[mixed]
    best = gain[at].copy()
    back = np.zeros(gain.shape, dtype=np.int8)
    own = np.arange(gain.shape[1], dtype=np.int8)
    for i in range(1, left[0]):
        k = int(np.searchsorted(-left, -i, side="left"))
        b = best[:k]
        top = b.argmax(axis=1)
        limit = b[np.arange(k), top] - switch
        stay = b >= limit[:, None]
        back[at[:k] + i] = np.where(stay, own, top[:, None])
        best[:k] = np.where(stay, b, limit[:, None]) + gain[at[:k] + i]
    path[at + left - 1] = best.argmax(axis=1)
    for i in range(left[0] - 1, 0, -1):
        k = int(np.searchsorted(-left, -i, side="left"))
        path[at[:k] + i - 1] = back[at[:k] + i, path[at[:k] + i]]
    return path


def _train(dim: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        weight = np.zeros(GRAMS)
        for i in range(0, len(pdf), 256):
            texts = [_closed(t, [(0, len(t))]) for t in pdf["text"].iloc[i : i + 256]]
            ids, owner = sentence_grams("".join(texts))
            some, _, norm, size = scored(ids, owner, np.zeros((0, GRAMS)), 1)
            weight += np.bincount(ids, weights=np.repeat(1 / norm, size), minlength=GRAMS) if len(some) else 0
        first, last = _halves(letter_vectors(dim))
        total = (first * (weight.astype(np.float32).reshape(729, 729) @ last)).sum(axis=0, dtype=np.float64) / dim**0.5
        return pd.DataFrame({"lang": [key[0]], "prototype": [total.tolist()]})

    return run


def train(df: DataFrame, text: str, label: str, per_language: int = TRAIN_PER_LANGUAGE, refine_per_language: int = REFINE_PER_LANGUAGE, dim: int = DIM, sample_chars: int = SAMPLE_CHARS, refine_chars: int = REFINE_CHARS) -> np.ndarray:
    """Prototypes of the languages (rows as in LANGUAGES) from labelled rows.

    At most ``per_language`` rows of each language are used, the ones with the
    smallest hash of their text, so the sample is bounded and the same at every run;
    of a text over ``sample_chars`` a stretch of that length is used, at a place its
    hash decides. The prototypes are then retrained on the sentences of
    ``refine_per_language`` of these rows, ``refine_chars`` of each. Wrong labels are
    outvoted in the bundle. A language without rows gets a zero prototype and is
    never chosen.
    """
    rows = df.select(label_language(F.col(f"`{label}`")).alias("lang"), F.col(f"`{text}`").alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}{2}"))
    # The share of the hash range that holds the sample is known from counts, so only about the sample is shuffled.
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    at = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    stretch = lambda n: F.substr(F.col("text"), (F.lit(1) + F.pmod(F.xxhash64("text", F.lit(n)), F.greatest(F.lit(1), F.length("text") - n))).cast("int"), F.lit(n))
    limit = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, 1.5 * (per_language + 20) / n) * (1 << 30)))]) if counts else F.create_map(F.lit(""), F.lit(0))
    sample = rows.withColumn("at", at).where(F.col("at") < F.element_at(limit, F.col("lang"))).select("lang", "at", stretch(sample_chars).alias("text")).dropDuplicates(["lang", "text"])
    w = Window.partitionBy("lang").orderBy("at", "text")
    kept = sample.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_language).select("lang", "text", "_k")
    bundles = {r["lang"]: np.array(r["prototype"]) for r in kept.groupBy("lang").applyInPandas(_train(dim), "lang string, prototype array<double>").collect()}
    unit = np.array([bundles[x] / max(1e-9, np.linalg.norm(bundles[x])) if x in bundles else np.zeros(dim) for x in LANGUAGES])
    short = kept.where(F.col("_k") <= refine_per_language).orderBy("lang", "_k").select("lang", stretch(refine_chars).alias("text")).collect()
    return refine(unit, [(LANGUAGES.index(r["lang"]), r["text"]) for r in short])


def refine(prototypes: np.ndarray, labelled: list[tuple[int, str]], epochs: int = 12, margin: float = 0.06, rate: float = 0.05) -> np.ndarray:
    """Retrain bundled prototypes on sentences.

    A sentence that a prototype claims wrongly, or by less than ``margin``, is added
    to its own language's prototype and taken from the other. Only sentences count
    whose label agrees with the language found for their stretch of text, so wrong
    labels and foreign stretches teach nothing.
    """
    model = Profiles(prototypes)
    some = np.array([np.any(p) for p in prototypes])
    found: dict[str, int] = {}
    for own, text in labelled:
        letters = [x for x in map(_letters, sentences(text)) if len(x) > 3]
        if letters:
            dots, norms = model.bundles(letters)
            path = segment(np.where(some, dots, -1e9), norms, SWITCH)
            found.update((x, own) for x, k in zip(letters, path) if k == own)
    if len(set(found.values())) < 2:
        return prototypes
    flat, number = sentence_grams("".join(x + "\x00" for x in found))
    _, _, norm, size = scored(flat, number, np.zeros((0, GRAMS)), 1)
    starts = np.cumsum(size) - size
    ids, back = np.unique(flat, return_inverse=True)
    unit = np.repeat(1 / (norm * prototypes.shape[1] ** 0.5), size)
    owner = np.repeat(np.arange(len(size)), size)
    own = np.fromiter(found.values(), dtype=int)
    p = np.array(model.p, dtype=np.float64)
    at = np.arange(len(own))
    for _ in range(epochs):
        length = np.linalg.norm(p, axis=1, keepdims=True)
        table = products_with(ids, model.v, p / np.where(length == 0, 1, length))
        cos = np.add.reduceat(table[back] * unit[:, None], starts, axis=0)
        cos[:, ~some] = -9
        mine = cos[at, own]
        cos[at, own] = -9
        rival = cos.argmax(axis=1)
        weak = mine - cos[at, rival] < margin
        if not weak.any():
            break
        for k in np.flatnonzero(some):
            # The bundles to add are summed n-gram by n-gram: the same by linearity.
            step = (weak & (own == k)).astype(float) - (weak & (rival == k))
            change = np.bincount(back, weights=step[owner] * unit, minlength=len(ids))
            p[k] += rate * bundled(ids, change, model.v) / weak.sum() ** 0.5
    p[~some] = 0
    return p


_OUT = "seg_no int, lang string, confidence double, n_sentences int, start int, stop int"


def _portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of portions with a bounded number of texts and of characters, or one longer text."""
    lo = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if i > lo and (chars > CHARS or i - lo >= TEXTS):
            yield lo, i
            lo, chars = i, len(t or "")
    if lo < len(texts):
        yield lo, len(texts)


def _found(texts: list[str | None], table: np.ndarray, usable: np.ndarray, dim: int, switch: float, least: int) -> tuple[np.ndarray, ...]:
    """The text, seg_no, language (-1 if undetermined), confidence, sentences, start and stop of every stretch."""
    spans, holder, joined = [], [], []
    for i, t in enumerate(texts):
        if t:
            of = breaks(t)
            spans += of
            holder += [i] * len(of)
            joined.append(_closed(t, of))
    holder, span = np.array(holder, dtype=np.int64), np.array(spans, dtype=np.int64).reshape(-1, 2)
    some, dots, norms, size = scored(*sentence_grams("".join(joined)), table, dim)
    owner = holder[some]
    enough = np.bincount(owner, weights=size, minlength=len(texts)) >= least if len(some) else np.zeros(len(texts), dtype=bool)
    told = enough[owner]
    some, dots, norms, owner = some[told], np.where(usable, dots[told], -1e9), norms[told], owner[told]
    # Texts without enough letters get one row all the same.
    rest = np.flatnonzero(~enough & np.array([bool(t) for t in texts]))
    last = np.array([len(texts[i]) for i in rest], dtype=np.int64)
    zero = np.zeros(len(rest), dtype=np.int64)
    blank = (rest, zero, zero - 1, zero.astype(float), zero, zero, last)
    if not len(some):
        return blank
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    path = segments(gains(dots, norms), first, switch)
    fresh_text = np.concatenate([[True], owner[1:] != owner[:-1]])
    cut = np.flatnonzero(fresh_text | np.concatenate([[True], path[1:] != path[:-1]]))
    stop = np.append(cut[1:], len(path)) - 1
    text_no = np.cumsum(fresh_text[cut]) - 1
    begin = np.flatnonzero(fresh_text[cut])
    number = np.arange(len(cut)) - begin[text_no] + 1
    number = np.where(np.bincount(text_no)[text_no] == 1, 0, number)
    d = np.add.reduceat(dots, cut, axis=0) / np.sqrt(np.add.reduceat(norms**2, cut))[:, None]
    at, best = np.arange(len(cut)), path[cut].astype(np.int64)
    own = d[at, best]
    d[at, best] = -np.inf
    sure = 1 / (1 + np.exp(np.clip(-20 * (own - d.max(axis=1)), -700, 700)))
    out = (owner[cut], number, best, sure, stop - cut + 1, span[some[cut], 0], span[some[stop], 1])
    return tuple(np.concatenate(x) for x in zip(out, blank))


def _detect(table: np.ndarray, usable: np.ndarray, dim: int, switch: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*LANGUAGES, UNDETERMINED])
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for lo, hi in _portions(texts):
                row, number, lang, sure, n, start, stop = _found(texts[lo:hi], table, usable, dim, switch, least)
                if len(row):
                    cols = [c.take(pa.array(row + lo)) for c in batch.columns[:-1]]
                    cols += [pa.array(number.astype(np.int32)), names.take(pa.array(np.where(lang < 0, len(LANGUAGES), lang))), pa.array(sure), *[pa.array(x.astype(np.int32)) for x in (n, start, stop)]]
                    yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], "seg_no", "lang", "confidence", "n_sentences", "start", "stop"])

    return run


def detect(df: DataFrame, ids: list[str], text: str, prototypes: np.ndarray, switch: float = SWITCH, least: int = LEAST_GRAMS) -> DataFrame:
    """Languages of whole texts: ``ids``, seg_no, lang, confidence, n_sentences, start, stop.

    A text in one language gives one row with seg_no 0, a text in several one row per
    stretch of whole sentences, numbered from 1 in order; start and stop are character
    offsets. Texts without letters (null, blank, numbers only) give no row; texts with
    fewer than ``least`` n-grams of Latin letters, as those in another script, give
    one with the language ``und``, confidence 0 and no sentences. Quoted phrases of up
    to QUOTE_WORDS words and QUOTE_CHARS characters do not count, nor do tags of up to
    TAG_CHARS. Repeated rows each give their result. The whole of every text is read.
    A change of language must gain ``switch``. With untrained prototypes there is no
    result. A result column named like one of ``ids`` is lengthened by ``_``.
    """
    names = [f"i{k}" for k in range(len(ids))]
    usable = np.array([np.any(p) for p in prototypes])
    inner = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(ids, names)], F.col(f"`{text}`").alias("_text")).where(F.col("_text").rlike("\\p{L}") if usable.any() else F.lit(False))
    head = ", ".join(f"{n} {inner.schema[n].dataType.simpleString()}" for n in names)
    model = Profiles(prototypes)
    out = inner.mapInArrow(_detect(model.table, usable, model.dim, switch, least), f"{head}, {_OUT}")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, ids)], *[F.col(x.split()[0]).alias(fresh(x.split()[0], ids)) for x in _OUT.split(", ")])
