"""Per-document text statistics and structural profiles, by Jensen-Shannon divergence.

A text is cut into runs of like lines. Each run's distribution over single function words and over classes of tokens and
characters is compared with profiles: those of prose are made for each language, from its function words, those of other
matter for no language. The nearest profile names the run. Characters are then added up per kind, so that a prose text
with a short table in it stays prose. Hard-wrapped lines belong to one run, so short last lines do no harm.

Profiles start from shapes that describe each kind of matter and from the ranks of the function words, and are fitted on a
bounded sample of labelled documents; without labels the start stands.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from axiomill.plans.cut import cut

KINDS = ("prose", "code", "list", "table", "junk")

# The most frequent function words of four languages, in order of rank.
FUNCTION_WORDS = {
    "en": "the of and to a in is it that for was on with as be by this at from are not or but have had has they you which were their there been if will would can when who what so its than more some into them then these only other about after do did does my i we he she up out over also any each such because how before between both under again while",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man wenn was wir ich weil denn ob ohne unter dann sein ihre wurde kann gegen vom schon alle diese hier da",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou son nous comme mais on tout elle si leur cette aux sa ses fait été être y sans car dont très aussi bien peut même où entre après avant sous quand encore vous je lui ces deux cela chaque il ont",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto antes algunos qué unos yo otro es son ser solo hemos está cada",
}
LANGUAGES = tuple(FUNCTION_WORDS)
VOCABULARY = tuple(dict.fromkeys(w for text in FUNCTION_WORDS.values() for w in text.split()))
COMMON = {w: i for i, w in enumerate(VOCABULARY)}

#: Token classes of a run, in the order of the profiles' numbers.
CLASSES = ("function word", "lower-case word", "capitalised word", "name or mixed token", "number", "sentence mark", "bracket", "separator", "other symbol", "fragment")

# Share of each class, typical of the kind of matter.
PROFILES = {
    ("prose", "running text"): (0.42, 0.32, 0.06, 0.07, 0.02, 0.10, 0.00, 0.00, 0.01, 0.00),
    ("prose", "name-laden text"): (0.32, 0.28, 0.12, 0.13, 0.03, 0.10, 0.00, 0.00, 0.02, 0.00),
    ("prose", "problem statement"): (0.24, 0.45, 0.10, 0.02, 0.03, 0.12, 0.00, 0.01, 0.03, 0.00),
    ("prose", "unpunctuated text"): (0.22, 0.72, 0.01, 0.00, 0.05, 0.00, 0.00, 0.00, 0.00, 0.00),
    ("prose", "text in capitals"): (0.22, 0.00, 0.60, 0.00, 0.05, 0.13, 0.00, 0.00, 0.00, 0.00),
    ("prose", "marked-up text"): (0.11, 0.27, 0.08, 0.00, 0.02, 0.06, 0.00, 0.00, 0.46, 0.00),
    ("prose", "chat"): (0.44, 0.36, 0.01, 0.06, 0.02, 0.10, 0.00, 0.00, 0.01, 0.00),
    ("code", "formulas"): (0.00, 0.14, 0.03, 0.26, 0.04, 0.07, 0.36, 0.00, 0.10, 0.00),
    ("code", "nested formulas"): (0.05, 0.10, 0.00, 0.22, 0.00, 0.10, 0.42, 0.00, 0.08, 0.03),
    ("code", "comments"): (0.24, 0.24, 0.00, 0.27, 0.00, 0.25, 0.00, 0.00, 0.00, 0.00),
    ("list", "entries"): (0.00, 0.44, 0.00, 0.36, 0.00, 0.10, 0.06, 0.00, 0.04, 0.00),
    ("list", "entries of capitalised nouns"): (0.00, 0.22, 0.30, 0.26, 0.00, 0.14, 0.08, 0.00, 0.00, 0.00),
    ("list", "numbered entries"): (0.00, 0.34, 0.00, 0.26, 0.18, 0.04, 0.16, 0.00, 0.02, 0.00),
    ("list", "bulleted entries"): (0.00, 0.36, 0.00, 0.26, 0.00, 0.00, 0.06, 0.00, 0.32, 0.00),
    ("list", "index"): (0.00, 0.24, 0.00, 0.20, 0.18, 0.00, 0.05, 0.32, 0.01, 0.00),
    ("table", "ruled rows"): (0.00, 0.22, 0.00, 0.14, 0.18, 0.05, 0.00, 0.38, 0.03, 0.00),
    ("table", "separated values"): (0.00, 0.24, 0.00, 0.14, 0.18, 0.30, 0.00, 0.10, 0.04, 0.00),
    ("table", "marked-up rows"): (0.00, 0.40, 0.00, 0.07, 0.08, 0.02, 0.36, 0.00, 0.07, 0.00),
    ("junk", "word salad"): (0.02, 0.90, 0.05, 0.00, 0.00, 0.03, 0.00, 0.00, 0.00, 0.00),
    ("junk", "capitalised salad"): (0.00, 0.03, 0.95, 0.00, 0.00, 0.02, 0.00, 0.00, 0.00, 0.00),
    ("junk", "broken scan"): (0.10, 0.14, 0.02, 0.05, 0.06, 0.13, 0.00, 0.04, 0.22, 0.24),
    ("junk", "encoded data"): (0.00, 0.02, 0.01, 0.40, 0.02, 0.00, 0.00, 0.00, 0.15, 0.40),
    ("junk", "machine log"): (0.00, 0.02, 0.00, 0.38, 0.24, 0.20, 0.07, 0.00, 0.09, 0.00),
    ("junk", "page furniture"): (0.05, 0.04, 0.50, 0.00, 0.00, 0.00, 0.12, 0.29, 0.00, 0.00),
    ("junk", "symbols"): (0.00, 0.00, 0.00, 0.00, 0.00, 0.06, 0.12, 0.10, 0.72, 0.00),
}
_NAMES = tuple(PROFILES)
_KIND = np.array([KINDS.index(k) for k, _ in _NAMES])
_COMMENTS = _NAMES.index(("code", "comments"))

#: Tokens a run's distribution is thinned with, of the profile it is compared with: few tokens say little.
THIN = 20.0
#: Tokens that the start of a profile, and of a language's words, weighs in the fit.
START = 2000.0
#: Labelled documents in a fit, and its rounds.
FIT_DOCS = 2000
FIT_ROUNDS = 2


@dataclass
class Model:
    """``shares``: of each class per profile. ``words``: of each function word among its language's, per language."""

    shares: np.ndarray
    words: np.ndarray


def start() -> Model:
    """The profiles before any fit: the shapes, and words by Zipf's rule over their ranks."""
    q = np.array(list(PROFILES.values()), float)
    words = np.zeros((len(LANGUAGES), len(VOCABULARY)))
    for k, text in enumerate(FUNCTION_WORDS.values()):
        for rank, w in enumerate(dict.fromkeys(text.split())):
            words[k, COMMON[w]] = 1 / (rank + 3)
    return Model(q / q.sum(axis=1, keepdims=True), words / words.sum(axis=1, keepdims=True))


_WORD = re.compile(r"[^\W_]+")
_LEADER = re.compile(r"\.{4,}|-{3,}|={3,}")
_GAP = re.compile(r"(?<=\S)(?: {3,}|\t)(?=\S)")
_CODE = re.compile(r"\s*(?:\((?!\d+\))|; |fof\(|cnf\(|tff\(|thf\()")
_SENTENCE = re.compile(r"[.!?\n]+")
_END = ".!?:;…"


class _Codes(dict):
    """Code of a word, remembered: its class, or beyond the classes its place among the function words."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        low = w.lower()
        if low in COMMON:
            c = len(CLASSES) + COMMON[low]
        elif w.isdigit():
            c = 4
        elif len(w) == 1 or len(w) > 40:
            c = 9
        elif w.isalpha():
            c = 1 if w.islower() else 2 if w.istitle() or w.isupper() else 3
        else:
            c = 3
        self[w] = c
        return c


_CODE_OF = _Codes()
_code = _CODE_OF.__getitem__


def token_counts(run: str) -> tuple[list[int], dict[int, int], int, int, int]:
    """Tokens of each class in a run, its function words by place, its words, their letters and digits, and its non-space
    characters."""
    words = _WORD.findall(run)
    by = Counter(map(_code, words))
    common = {c - len(CLASSES): k for c, k in by.items() if c >= len(CLASSES)}
    length = len("".join(words))
    count = run.count
    marks = count(",") + count("!") + count("?") + count(";") + count(":")
    dots, lines = count("."), 0
    if "..." in run or "---" in run or "===" in run:
        found = _LEADER.findall(run)
        lines = len(found)
        dots -= sum(len(x) for x in found if x[0] == ".")
    gaps = len(_GAP.findall(run)) if "   " in run or "\t" in run else 0
    brackets = count("(") + count(")") + count("[") + count("]") + count("{") + count("}") + count("<") + count(">")
    size = len("".join(run.split()))
    # what is neither word, mark nor bracket; hyphens are left out, "&%" marks a linked term in running text
    pipes = count("|")
    other = size - length - marks - count(".") - brackets - pipes - count("-") - count("'") - count('"') - 2 * count("&%")
    n = [sum(common.values()), by[1], by[2], by[3], by[4], marks + dots, brackets, pipes + lines + gaps, max(0, other), by[9]]
    return n, common, len(words), length, size


def _bits(x: np.ndarray) -> np.ndarray:
    return x * np.log2(np.maximum(x, 1e-300))


def languages(words: list[dict[int, int]], model: Model) -> np.ndarray:
    """The language whose function words fit a run's best; the first where it has none."""
    lean = np.log(model.words + 1e-4)
    out = np.zeros(len(words), int)
    for r, w in enumerate(words):
        if w:
            out[r] = int((lean[:, list(w)] * list(w.values())).sum(axis=1).argmax())
    return out


def divergences(counts: np.ndarray, words: list[dict[int, int]], model: Model, language: np.ndarray | None = None) -> np.ndarray:
    """Jensen-Shannon divergence, in bits, of each run from each profile, over function words and classes.

    ``counts`` are the runs' tokens per class, the first being all function words, which ``words`` tells apart. A prose
    profile has the words of the run's ``language``, another those of all languages alike. Each distribution is thinned
    with THIN tokens of the profile it is compared with, so that short runs aren't far from everything.
    """
    q, n = model.shares, counts.sum(axis=1)
    language = languages(words, model) if language is None else language
    m = (n + THIN)[:, None]
    out = np.zeros((len(counts), len(q)))
    for j in range(1, len(CLASSES)):
        p = (counts[:, j : j + 1] + THIN * q[:, j]) / m
        out += (_bits(p) + _bits(q[:, j])) / 2 - _bits((p + q[:, j]) / 2)
    # words a run lacks: its thinned share of them is the profile's times beta
    beta = THIN / (n + THIN)
    lacks = (_bits(beta) / 2 - _bits((1 + beta) / 2))[:, None]
    prose, share = _KIND == 0, q[:, 0]
    any_ = model.words.mean(axis=0)
    met = np.zeros((len(counts), 2))
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    if len(row):
        at = np.fromiter((i for w in words for i in w), int, len(row))
        k = np.fromiter((c for w in words for c in w.values()), float, len(row))
        own, all_ = model.words[language[row], at], any_[at]
        np.add.at(met, row, np.stack([own, all_], axis=1))
        w = np.where(prose, own[:, None], all_[:, None]) * share
        p = (k[:, None] + THIN * w) / m[row]
        part = (_bits(p) + _bits(w)) / 2 - _bits((p + w) / 2)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[first]] += np.add.reduceat(part, first, axis=0)
    left = 1 - np.where(prose, met[:, :1], met[:, 1:])
    return out + np.maximum(left, 0) * share * lacks


def nearest(counts: np.ndarray, words: list[dict[int, int]], code: np.ndarray, model: Model, language: np.ndarray | None = None) -> np.ndarray:
    """Place in PROFILES of the profile nearest to each run; comments only count among lines that look like ``code``."""
    d = divergences(counts, words, model, language)
    d[~code, _COMMENTS] = np.inf
    return d.argmin(axis=1)


def _look(line: str) -> str:
    """What a line looks like by itself: c(ode), t(able) or w(ords)."""
    if line[0] in " \t(;fcth" and _CODE.match(line):
        return "c"
    if "|" in line and line.count("|") >= 2 or "<td" in line or "...." in line or "---" in line:
        return "t"
    if ("   " in line or "\t" in line) and _GAP.search(line.strip()):
        return "t"
    cells = max(line.count(","), line.count(";"))
    if cells >= 2:
        words = _WORD.findall(line)
        if len(words) <= 3 * (cells + 1) and not any(_code(w) >= len(CLASSES) for w in words):
            return "t"
    return "w"


def runs(text: str) -> Iterator[tuple[str, bool]]:
    """The text in runs of like lines, and whether they look like code; blank lines and changes of look end a run."""
    held: list[str] = []
    look = ""
    for line in text.splitlines():
        if not line or line.isspace():
            if held:
                yield "\n".join(held), look == "c"
                held = []
            continue
        # the rest of a formula is indented under it
        now = "c" if look == "c" and held and line[0] in " \t" else _look(line)
        if held and now != look:
            yield "\n".join(held), look == "c"
            held = []
        look = now
        held.append(line)
    if held:
        yield "\n".join(held), look == "c"


def _repeats(run: str) -> bool:
    """Whether most of a run's sentences are repeats of others in it."""
    parts = [x.strip() for x in _SENTENCE.split(run)]
    parts = [x for x in parts if x]
    return len(parts) >= 6 and len(set(parts)) < len(parts) / 2


#: A run of fewer tokens is a heading or a stray line and goes with the run after it, else before it.
SHORT = 5


@dataclass
class _Runs:
    """The runs of some texts: counts, function words, whether they look like code, the texts they are of and their sizes.

    ``plan`` has for each text its runs in order, -1 for one too short to stand alone, with their non-space characters.
    """

    counts: list[list[int]]
    words: list[dict[int, int]]
    code: list[bool]
    pieces: list[str]
    plan: list[list[tuple[int, int]]]
    basic: list[dict]


def _cut(texts: list[str]) -> _Runs:
    out = _Runs([], [], [], [], [], [])

    def keep(n: list[int], w: dict[int, int], c: bool, run: str) -> int:
        out.counts.append(n)
        out.words.append(w)
        out.code.append(c)
        out.pieces.append(run)
        return len(out.counts) - 1

    for text in texts:
        own: list[tuple[int, int]] = []
        n_words = common = length = solid = 0
        for run, c in runs(text):
            n, by, w, letters, size = token_counts(run)
            n_words += w
            length += letters
            common += n[0]
            solid += size
            own.append((keep(n, by, c, run) if sum(n) >= SHORT else -1, size))
        if all(k < 0 for k, _ in own):
            n, by, _, _, size = token_counts(text)
            own = [(keep(n, by, False, text), size)]
        out.plan.append(own)
        lines = [x for x in map(str.rstrip, text.splitlines()) if x]
        out.basic.append({
            "n_words": n_words,
            "mean_word_length": length / n_words if n_words else 0.0,
            "symbol_ratio": (solid - length) / solid if solid else 0.0,
            "punctuated_lines": sum(x[-1] in _END for x in lines) / len(lines) if lines else 0.0,
            "common_words": common / n_words if n_words else 0.0,
        })
    return out


def statistics(texts: list[str], model: Model | None = None) -> list[dict]:
    """Counts of each non-blank text, its characters by kind, its kind and, of its prose, the language."""
    model = model or start()
    got = _cut(texts)
    tongue = languages(got.words, model)
    kinds = _KIND[nearest(np.array(got.counts, float).reshape(-1, len(CLASSES)), got.words, np.array(got.code, bool), model, tongue)].tolist() if got.counts else []
    for own, row in zip(got.plan, got.basic):
        by, spoken = [0] * len(KINDS), [0] * len(LANGUAGES)
        waiting, last = 0, -1
        for k, size in own:
            if k < 0:
                waiting += size
                continue
            last = kinds[k]
            if last == 0 and _repeats(got.pieces[k]):
                last = KINDS.index("junk")
            if last == 0:
                spoken[tongue[k]] += size
            by[last] += size + waiting
            waiting = 0
        by[last] += waiting
        total = sum(by)
        row["prose_share"] = by[0] / total if total else 0.0
        row["kind"] = KINDS[by.index(max(by))]
        row["language"] = LANGUAGES[spoken.index(max(spoken))] if any(spoken) else None
    return got.basic


def _weigh(model: Model):
    """Per partition of (text, kind): the tokens of the runs whose nearest profile is of the kind their document is
    labelled with, by profile and class (``what`` 0), and the function words of such prose by language (``what`` 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares, words = np.zeros(model.shares.shape), np.zeros(model.words.shape)
        for b in batches:
            texts, said = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k in range(0, len(texts), 500):
                got = _cut(texts[k : k + 500])
                label = np.full(len(got.counts), -1)
                for own, kind in zip(got.plan, said[k : k + 500]):
                    label[[i for i, _ in own if i >= 0]] = KINDS.index(kind)
                counts, tongue = np.array(got.counts, float).reshape(-1, len(CLASSES)), languages(got.words, model)
                near = nearest(counts, got.words, np.array(got.code, bool), model, tongue)
                ok = (_KIND[near] == label) & ~np.array([_KIND[p] == 0 and _repeats(x) for p, x in zip(near, got.pieces)], bool)
                np.add.at(shares, near[ok], counts[ok])
                for r in np.flatnonzero(ok & (label == 0)):
                    for w, c in got.words[r].items():
                        words[tongue[r], w] += c
        for what, x in ((0, shares), (1, words)):
            i, j = np.nonzero(x)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), what)), pa.array(i), pa.array(j), pa.array(x[i, j])], names=["what", "i", "j", "n"])

    return run


def fit(docs: DataFrame, doc: str, text: str, labels: DataFrame, labelled: str, kind: str, most: int = FIT_DOCS, rounds: int = FIT_ROUNDS) -> Model:
    """Profiles and words fitted on at most ``most`` labelled documents, the same ones at every run.

    ``labels`` says of some documents which of KINDS they are; those called two kinds, or another, are left out, so are
    blank texts. Only runs that the profiles of their document's kind attract count, so that inserts of another kind and
    wrong labels stay out. What reaches the driver is one number per profile and class, and per language and word.
    """
    known = labels.select(F.col(labelled).cast("long").alias("d"), F.lower(F.trim(F.col(kind))).alias("kind")).dropna().groupBy("d").agg(F.min("kind").alias("kind"), F.max("kind").alias("k2"))
    known = known.where((F.col("kind") == F.col("k2")) & F.col("kind").isin(*KINDS)).select("d", "kind").orderBy(F.xxhash64("d"), "d").limit(most)
    texts = docs.select(F.col(doc).cast("long").alias("d"), F.col(text).alias("text")).where(F.col("text").rlike(r"\S"))
    sample = cut(texts.join(F.broadcast(known), "d").select("text", "kind"), "labelled")
    model = start()
    for _ in range(rounds):
        got = sample.df.mapInArrow(_weigh(model), "what bigint, i bigint, j bigint, n double").groupBy("what", "i", "j").agg(F.sum("n").alias("n")).collect()
        first = start()
        shares, words = START * first.shares, START * first.words
        for r in got:
            (words if r["what"] else shares)[r["i"], r["j"]] += r["n"]
        model = Model(shares / shares.sum(axis=1, keepdims=True), words / words.sum(axis=1, keepdims=True))
    sample.drop()
    return model


_OUT = pa.schema(
    [("doc", pa.int64()), ("n_words", pa.int64()), ("mean_word_length", pa.float64()), ("symbol_ratio", pa.float64()), ("punctuated_lines", pa.float64()),
     ("common_words", pa.float64()), ("prose_share", pa.float64()), ("kind", pa.string()), ("language", pa.string())]
)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t and not t.isspace()]
            for k in range(0, len(held), 500):
                part = held[k : k + 500]
                rows = statistics([t for _, t in part], model)
                yield pa.RecordBatch.from_pylist([{"doc": i} | r for (i, _), r in zip(part, rows)], schema=_OUT)

    return run


def text_quality(docs: DataFrame, doc: str, text: str, model: Model | None = None) -> DataFrame:
    """Figures per document: ``doc, n_words, mean_word_length, symbol_ratio, punctuated_lines, common_words, prose_share, kind,
    language``.

    ``prose_share`` is the share of non-space characters in runs nearest to a prose profile of ``model`` (without one, of
    the start), ``kind`` the kind with most characters, ``language`` that of most of its prose. Null or blank texts give no
    row; every other row gives one, repeated ids too. Whole texts are read; there is no shuffle.
    """
    d = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    return d.mapInArrow(_score(model or start()), "doc bigint, n_words bigint, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double, prose_share double, kind string, language string")
