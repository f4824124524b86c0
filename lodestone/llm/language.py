"""Missing or wrong document language labels (problem 10): hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of an n-gram binds its letters'
vectors, each permuted by its place, by element-wise multiplication; the vector of a text
bundles its n-grams by addition. Languages are prototypes, bundles of labelled text.
Texts are compared with them by cosine. Bundling is linear, so the dot product of a text
with a prototype is the sum of those of its n-grams; these are computed once an n-gram
and worker and kept in a table. The length of a text's own vector divides all its cosines
alike, so neither the best language nor its lead in parts of the best depends on it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.common import blank_trim

DIMENSIONS = 4096
PER_LANGUAGE = 400  #: documents per language that prototypes are fitted on, at most
PER_DOCUMENT = 64  #: sentences of each of them, spread over its whole text, at most
UNKNOWN = "und"  #: letters of no known script
ROUNDS = 2  #: times the fitted segments are assigned anew and prototypes rebuilt
LETTERS = 128
SHORT = 20  #: units with fewer n-grams lean on their neighbours
LEAST = 10  #: characters of a unit that prototypes are fitted on
SENTENCE = re.compile(r"[.!?]+\s+|\u3002")
FENCE = re.compile(r"^ {0,3}(```|~~~)")
INLINE = re.compile(r"`[^`]*`")
NAME = re.compile(r"[_/\\]|[a-z][A-Z]")

#: Letters with a class of their own, besides a to z.
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøœùúûüýÿß"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюяё"


def _classes() -> np.ndarray:
    """Letter class of every character of the basic plane; 0 separates words. Kana and
    Han share classes by their code, the two kanas and Han apart."""
    table = np.zeros(0x10000, np.uint8)
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = 1 + i
    at = 27
    for letter in ACCENTED + CYRILLIC:
        table[ord(letter)] = at
        if len(letter.upper()) == 1:
            table[ord(letter.upper())] = at
        at += 1
    for start, end, n in ((0x3041, 0x3097, 20), (0x30A1, 0x30FB, 8), (0x4E00, 0xA000, 8)):
        table[start:end] = at + (np.arange(end - start) % n)
        at += n
    assert at <= LETTERS
    return table


CLASSES = _classes()
#: Letters of scripts that no language here is written in.
FOREIGN = np.array([chr(i).isalpha() for i in range(0x10000)]) & (CLASSES == 0)


def words_of(line: str) -> str:
    """A line without inline code and without words that are names of code, files or addresses."""
    if "`" in line:
        line = INLINE.sub(" ", line)
    return " ".join(w for w in line.split() if not NAME.search(w)) if NAME.search(line) else line


def foreign(parts: list[str]) -> np.ndarray:
    """Whether more letters of a part are of unknown scripts than of known ones."""
    codes = np.minimum(np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32), 0xFFFF)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    unknown = np.bincount(owner, FOREIGN[codes], len(parts))
    return unknown > np.bincount(owner, CLASSES[codes] > 0, len(parts))


def trigrams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letter trigrams of all parts, and the part of each. Runs of other
    characters count as one blank, as do both ends of a part."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer("\n".join(["", *parts, ""]).encode("utf-32-le", "replace"), np.uint32)
    letters = CLASSES[np.minimum(codes, 0xFFFF)]
    owner = np.repeat(np.arange(-1, len(parts)), [1, *[len(p) + 1 for p in parts]])
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != 0) | (letters[:-1] != 0)
    letters, owner = letters[keep].astype(np.int64), owner[keep]
    if len(letters) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = (letters[1:-1] != 0) | (owner[:-2] == owner[2:])  # a blank between two parts joins nothing
    grams = (letters[:-2] << 14) | (letters[1:-1] << 7) | letters[2:]
    return grams[inside], owner[1:-1][inside]


class Profiles:
    """Prototypes of languages, and the table of n-gram scores built on demand."""

    def __init__(self, languages: list[str], prototypes: np.ndarray | None = None, dimensions: int = DIMENSIONS, seed: int = 3):
        self.languages, self.dimensions, self.seed = languages, dimensions, seed
        self.prototypes = prototypes
        self._ready = False

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "dimensions": self.dimensions, "seed": self.seed, "prototypes": self.prototypes, "_ready": False}

    def _prepare(self) -> None:
        if not self._ready:
            rng = np.random.default_rng(self.seed)
            letters = rng.choice(np.array([-1, 1], np.int8), (LETTERS, self.dimensions))
            self._places = [np.roll(letters, 2, 1), np.roll(letters, 1, 1), letters]
            self._at = np.full(1 << 21, -1, np.int32)
            self._scores = np.zeros((0, len(self.languages)), np.float32)
            self._ready = True

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """Bound vectors of n-grams."""
        self._prepare()
        a, b, c = self._places
        return a[grams >> 14] * b[(grams >> 7) & 127] * c[grams & 127]

    def bundle(self, grams: np.ndarray) -> np.ndarray:
        """Vector of a text or of many."""
        names, counts = np.unique(grams, return_counts=True)
        total = np.zeros(self.dimensions, np.float32)
        for i in range(0, len(names), 2048):
            total += counts[i : i + 2048].astype(np.float32) @ self.vectors(names[i : i + 2048]).astype(np.float32)
        return total

    def gram_scores(self, grams: np.ndarray) -> np.ndarray:
        """Dot products of n-grams with the prototypes of length one, in parts of an n-gram's length."""
        self._prepare()
        at = self._at[grams]
        if (at < 0).any():
            new = np.unique(grams[at < 0])
            unit = (self.prototypes / np.maximum(np.linalg.norm(self.prototypes, axis=1, keepdims=True), 1e-9)).astype(np.float32).T
            rows = [self.vectors(new[i : i + 2048]).astype(np.float32) @ unit / np.sqrt(self.dimensions) for i in range(0, len(new), 2048)]
            self._at[new] = len(self._scores) + np.arange(len(new))
            self._scores = np.concatenate([self._scores, *rows])
            at = self._at[grams]
        return self._scores[at]

    def score(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Dot products (part by language) and number of n-grams of many parts of texts."""
        grams, owner = trigrams(parts)
        sizes = np.bincount(owner, minlength=len(parts))
        sums = np.zeros((len(parts), len(self.languages)), np.float32)
        full = np.flatnonzero(sizes)
        if len(full):
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            sums[full] = np.add.reduceat(self.gram_scores(grams), starts, axis=0)
        return sums, sizes


def prose_lines(text: str) -> list[tuple[int, str]]:
    """(start, line) of the lines outside fenced code that aren't blank."""
    out, at, fenced = [], 0, False
    for line in text.split("\n"):
        if FENCE.match(line):
            fenced = not fenced
        elif not fenced and line.strip():
            out.append((at, line))
        at += len(line) + 1
    return out


def units(text: str) -> list[tuple[int, int, str]]:
    """(start, end, words) of what gets one language: the sentences of the prose lines."""
    out = []
    for at, line in prose_lines(text):
        start = 0
        if len(line) > 80:
            for m in SENTENCE.finditer(line):
                if m.end() < len(line):
                    out.append((at + start, at + m.end(), words_of(line[start : m.end()])))
                    start = m.end()
        out.append((at + start, at + len(line), words_of(line[start:])))
    return out


def _smooth(scores: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Scores in which short units also count half of what stands before and after them in their document."""
    out = scores.copy()
    same = (owner[1:] == owner[:-1])[:, None]
    short = (sizes < SHORT)[:, None]
    out[1:] += 0.5 * scores[:-1] * (same & short[1:])
    out[:-1] += 0.5 * scores[1:] * (same & short[:-1])
    return out


def identify(texts: list[str | None], profiles: Profiles) -> list[list[tuple[int, int, str, int, float]]]:
    """Segments of every text: start, end (characters), language, characters of prose, confidence.

    Every unit gets the language of the largest cosine, that is, of the largest sum of
    its n-grams' scores; consecutive units of one language form a segment. Its confidence
    is the lead of the best cosine over the second best, in parts of the best: 0 if
    undecided, at most 1. Units in scripts that no language here is written in, and those
    without any letters far and wide, are "und" with a confidence of 0.
    """
    owner, spans, parts = [], [], []
    for i, t in enumerate(texts):
        for start, end, words in units(t) if t else ():
            owner.append(i)
            spans.append((start, end, len(t[start:end].strip())))
            parts.append(words)
    found: list[list[tuple[int, int, str, int, float]]] = [[] for _ in texts]
    if not parts:
        return found
    own = np.array(owner)
    sums, sizes = profiles.score(parts)
    strange = foreign(parts)
    sums[strange] = 0
    smooth = _smooth(sums, np.where(strange, SHORT, sizes), own)
    best = np.where(strange | ~smooth.any(1), len(profiles.languages), smooth.argmax(1))
    cuts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (best[1:] != best[:-1])]))
    ends = np.concatenate([cuts[1:], [len(own)]])
    totals = np.add.reduceat(sums, cuts, axis=0)
    ranked = np.sort(totals, axis=1)
    second = ranked[:, -2] if ranked.shape[1] > 1 else np.zeros(len(ranked))
    lead = np.where(ranked[:, -1] > 0, (ranked[:, -1] - np.maximum(second, 0)) / np.maximum(ranked[:, -1], 1e-9), 0)
    chars = np.add.reduceat(np.array([s[2] for s in spans]), cuts)
    names = [*profiles.languages, UNKNOWN]
    for k, (a, b) in enumerate(zip(cuts.tolist(), ends.tolist())):
        found[owner[a]].append((spans[a][0], spans[b - 1][1], names[best[a]], int(chars[k]), float(lead[k]) if best[a] < len(profiles.languages) else 0.0))
    return found


def sentences(text: str | None, most: int = PER_DOCUMENT) -> list[str]:
    """What prototypes are fitted on: sentences of the text, every n-th if there are more than ``most``."""
    long_ones = [words for _, _, words in units(text) if len(words) >= LEAST] if text else []
    return long_ones[:: max(1, -(-len(long_ones) // most))]


def fit(sample: list[tuple[str, list[str]]], languages: list[str], dimensions: int = DIMENSIONS, rounds: int = ROUNDS) -> Profiles:
    """Prototypes from (language, sentences). Some labels are wrong: after the first bundling
    every unit is assigned to its nearest prototype, and prototypes are built again."""
    labelled = [(languages.index(lang), words) for lang, own in sample for words in own]
    parts = [words for _, words in labelled]
    grams, owner = trigrams(parts)
    assigned = np.array([k for k, _ in labelled], int)
    profiles = Profiles(languages, np.zeros((len(languages), dimensions), np.float32), dimensions)
    for step in range(rounds + 1):
        mine = assigned[owner] if len(owner) else owner
        bundles = np.array([profiles.bundle(grams[mine == k]) for k in range(len(languages))])
        lengths = np.linalg.norm(bundles, axis=1, keepdims=True)
        lengths = np.maximum(lengths, 1e-9)
        present = lengths > 1e-9
        # what all languages share tells nothing; the prototypes are what is left
        shared = (bundles / lengths)[present[:, 0]].mean(0) if present.any() else 0
        alone = present.sum() < 2
        profiles = Profiles(languages, np.where(present, bundles / lengths - (0 if alone else shared), 0).astype(np.float32), dimensions)
        if step < rounds and parts:
            assigned = profiles.score(parts)[0].argmax(1)
    return profiles


def named_language(label: Column, names: DataFrame, df: DataFrame) -> DataFrame:
    """``df`` with ``labelled``: the language that the label names, null for missing and unknown labels."""
    key = F.lower(blank_trim(label))
    spelled = names.select(F.col("label").alias("_label"), F.col("lang").alias("labelled"))
    return df.withColumn("_label", key).join(spelled, "_label", "left").drop("_label")


def train(documents: DataFrame, names: DataFrame, per_language: int = PER_LANGUAGE, per_document: int = PER_DOCUMENT, dimensions: int = DIMENSIONS) -> Profiles:
    """Fit on at most ``per_language`` labelled Markdown documents a language, chosen by a hash of
    their id, and at most ``per_document`` sentences of each. Ids are chosen first, from narrow
    rows and in each task before any is moved; only the chosen ones' texts are read, and
    only their sentences come to the driver."""
    prose = documents.filter(F.lower("path").endswith(".md") & (F.octet_length("text") > 0))
    labelled = named_language(F.col("lang"), names, prose.select("doc_id", "lang")).filter("labelled is not null")
    order = Window.partitionBy("labelled").orderBy(F.xxhash64("doc_id"), "doc_id")
    some = labelled.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_language).select("doc_id", "labelled")
    chosen = prose.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "labelled", "text")  # languages x per_language ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([sentences(t, per_document) for t in b.column(2).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), found], ["doc_id", "labelled", "sentences"])

    kind = chosen.schema["doc_id"].dataType.simpleString()
    sample = sorted((r.doc_id, r.labelled, r.sentences) for r in chosen.mapInArrow(cut, f"doc_id {kind}, labelled string, sentences array<string>").collect())
    languages = sorted({lang for _, lang, _ in sample})
    return fit([(lang, own) for _, lang, own in sample], languages or [UNKNOWN], dimensions)


def segments(documents: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, segment, start, length, lang, chars, confidence: the segments of every document.

    Fenced code belongs to no segment; null texts and texts without prose have none. A
    line of digits or signs only takes its neighbours' language. No shuffle.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(profiles)  # languages x dimensions numbers
    chosen = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()
    schema = f"`{key}` {kind}, segment int, start long, length long, lang string, chars long, confidence double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                found = identify(part.column(1).to_pylist(), model)
                flat = [(r, n, s[0], s[1] - s[0], s[2], s[3], s[4]) for r, own in enumerate(found) for n, s in enumerate(own)]
                columns = list(zip(*flat)) if flat else [[]] * 7
                keys = part.column(0).take(pa.array(columns[0], pa.int64()))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, t) for c, t in zip(columns[1:], kinds)]], [key, "segment", "start", "length", "lang", "chars", "confidence"])

    return chosen.mapInArrow(work, schema)


def by_language(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, lang, chars, share of the document's prose, confidence weighted by length.

    The sum over a document runs in a window over at most as many rows as there are languages.
    """
    each = found.groupBy(key, "lang").agg(F.sum("chars").alias("chars"), (F.sum(F.col("confidence") * F.col("chars")) / F.greatest(F.sum("chars"), F.lit(1))).alias("confidence"))
    whole = F.sum("chars").over(Window.partitionBy(key))
    return each.withColumn("share", F.col("chars") / whole)


def unlabelled(documents: DataFrame, names: DataFrame, profiles: Profiles, least_chars: int = 80, least_share: float = 0.2) -> DataFrame:
    """doc_id, lang: languages that a Markdown document is written in, to at least
    ``least_chars`` characters and ``least_share`` of its prose, but its label doesn't name."""
    prose = documents.filter(F.lower("path").endswith(".md"))
    written = by_language(segments(prose, profiles)).filter((F.col("lang") != UNKNOWN) & (F.col("chars") >= least_chars) & (F.col("share") >= least_share))
    labels = named_language(F.col("lang"), names, prose.select("doc_id", "lang")).select("doc_id", "labelled")
    return written.join(labels, "doc_id").filter(~F.col("lang").eqNullSafe(F.col("labelled"))).select("doc_id", "lang")


def accuracy(documents: DataFrame, names: DataFrame, profiles: Profiles) -> DataFrame:
    """labelled, documents, right, accuracy: Markdown documents whose label names a language of the
    profiles, and how many are mainly written in it. Some labels are wrong, so this is what a
    perfect classifier would have less those."""
    prose = documents.filter(F.lower("path").endswith(".md") & (F.octet_length("text") > 0))
    labels = named_language(F.col("lang"), names, prose.select("doc_id", "lang")).filter(F.col("labelled").isin(profiles.languages)).select("doc_id", "labelled")
    main = by_language(segments(prose, profiles)).groupBy("doc_id").agg(F.max_by("lang", F.struct("chars", "lang")).alias("main"))
    rows = labels.join(main, "doc_id").groupBy("labelled").agg(F.count("*").alias("documents"), F.count_if(F.col("main") == F.col("labelled")).alias("right"))
    return rows.withColumn("accuracy", F.round(F.col("right") / F.col("documents"), 6))
