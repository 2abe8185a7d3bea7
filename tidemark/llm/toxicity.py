"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, map_batches, materialize, small_side, texts

# Characters that look like Latin letters and do not come apart into them, script by script.
_LOOKALIKES = dict(zip(
    "аеорсухіѕјкмтвнԁԛԝһӏѵґєзђћџүѐёїўбпгилдшщ" "αβγεζηικνορτυχωϲϳ" "աոսօցհյզքվտղ" "ᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ" "ɑɐəɛɡɩıɨȷłøđħŧƀɓɔɖɗƒɠɦɫɱɲŋƥɾʂƭʋʉʍʎʒ",
    "aeopcyxisjkmtbhdqwhlvgeshhuueeiybnrnndww" "abyezhiknoptuxwcj" "wnuoghjzqvun" "abcdefghijklmnoprstuvwyz" "aaeegiiijlodhtbboddfghlmnnprstvuwyz",
))
_DIGITS = dict(zip("013457", "oieast"))
_SYMBOLS = dict(zip("@$!", "asi"))
_FOLD = str.maketrans(_LOOKALIKES)
#: Accents and other marks that combine with a letter, and characters without width.
_UNSEEN = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe00-\ufe0f\ufe20-\ufe2f\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff]")
_LEET = re.compile(r"(?<=[^\W\d_])[013457@$!]+(?=[^\W\d_])|(?<![^\W_])[013457@$]+(?=[^\W\d_]{2})")
_LEET_TABLE = str.maketrans(_DIGITS | _SYMBOLS)
_BREAK = re.compile(r"[\W\d_]+")
#: A word spelt out: four or more single letters.
_SPELT = re.compile(r"(?<= )(?:[^ ] ){3,}[^ ](?= )")

#: General insults: matched as the start of a word, before any label is seen.
SEED = (
    "idiot", "moron", "imbecile", "stupid", "dumbass", "worthless", "pathetic", "disgusting", "scum", "vermin", "loser", "asshole", "bastard", "bitch", "dimwit", "halfwit", "nitwit",
    "cretin", "dunce", "simpleton", "airhead", "numbskull", "blockhead", "knucklehead", "lowlife", "dirtbag", "scumbag", "sleazebag", "douchebag", "jackass", "dumbfuck", "fuckface",
    "motherfuck", "shithead", "bullshit", "dickhead", "crackhead", "parasit", "filthy", "degenerat", "subhuman", "despicabl", "repulsiv", "hypocrit",
)
#: In these phrases a term of the lexicon counts for nothing.
EXCEPTIONS = (
    "idiot proof", "idiot board", "idiot light", "idiot savant", "useful idiot theory", "stupid simple", "stupid question", "no stupid questions", "stupid fast", "keep it simple stupid",
    "trash can", "trash bin", "trash bag", "trash collection", "trash day", "trash pickup", "trash compactor", "trash icon", "trash folder", "recycle trash", "take out the trash",
    "pathetic fallacy", "clown fish", "clown car", "clown nose", "clown shoes", "clown costume", "clown school", "circus clown", "rodeo clown", "birthday clown", "class clown award",
    "sore loser", "loser pays", "losers bracket", "loser s bracket", "losers final", "biggest loser show", "pond scum", "soap scum", "scum layer", "scum removal", "scum village",
    "disgusting smell", "disgusting taste", "bitch of the litter", "brood bitch", "bitch puppies", "worthless check", "worthless stock", "worthless currency", "worthless option",
    "expires worthless", "bastard file", "bastard sword", "bastard toadflax", "bastard title", "vermin control", "vermin proof", "vermin infestation", "parasite host", "parasitic wasp",
    "parasitic plant", "parasitic capacitance", "parasitic infection", "parasitic load", "moron particle", "garbage collection", "garbage collector", "garbage truck", "garbage disposal",
    "garbage can", "dunce cap", "filthy rich", "degenerate matter", "degenerate case", "degenerate orbitals", "degenerate triangle", "dummy variable", "crash test dummy", "jackass penguin",
    "hypocritical fallacy", "rat race", "lab rat", "pig iron", "snake oil", "dog breed",
)


def fold(text: str) -> str:
    """Lower case, with what is made to look like other words made plain, every run of other characters one blank; blanks at both ends.

    Compatibility composition makes full width, mathematical alphabets and ligatures plain; marks that no letter takes and characters
    without width go; look-alike letters, and digits and marks within words, become Latin letters; letters spelt one by one are joined.
    Accented letters stay, as they tell words of a language apart: :func:`bare` takes their accents off.
    """
    text = text.lower()
    if not text.isascii():
        text = _UNSEEN.sub("", normalize("NFKC", text)).lower().translate(_FOLD)
    text = _LEET.sub(lambda m: m[0].translate(_LEET_TABLE), text)
    return _SPELT.sub(lambda m: m[0].replace(" ", ""), " " + _BREAK.sub(" ", text).strip() + " ")


class _Bases(dict):
    """Letters without their accents, found out as they are met."""

    def __missing__(self, code: int) -> int:
        first = ord(normalize("NFD", chr(code))[0])
        self[code] = first if first < 128 else code
        return self[code]


_BASES = _Bases()


def bare(folded: str) -> str:
    """Folded text without accents, letter for letter."""
    return folded.translate(_BASES)


@dataclass(frozen=True)
class Lexicon:
    """``terms``: weights by word start; the score is ``sigmoid(bias + coefs.features)``."""

    terms: tuple[tuple[str, float], ...]
    coefs: tuple[float, ...] = (1.0, 1.0, 0.0)
    bias: float = -3.0
    exceptions: tuple[str, ...] = EXCEPTIONS


@lru_cache(maxsize=4)
def _automaton(terms: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
    import ahocorasick

    auto = ahocorasick.Automaton()
    for phrase in exceptions:
        key = " " + phrase
        auto.add_word(key, (len(key), None, phrase))
    for term, weight in terms:
        key = " " + term
        if key not in auto:
            auto.add_word(key, (len(key), weight, term))
    auto.make_automaton()
    return auto


@lru_cache(maxsize=2)
def _general(terms: tuple[tuple[str, float], ...]) -> tuple[tuple[str, float], ...]:
    """The general insults among the terms: those that are looked for under accents too."""
    return tuple((t, w) for t, w in terms if t in SEED)


def matches(folded: str, lexicon: Lexicon) -> list[tuple[int, str, float]]:
    """Matches ``(start, term, weight)``: for each word the heaviest term that starts it, outside exception phrases.

    A word with accents is matched as it is by all terms, and without them by the general insults.
    """
    if not lexicon.terms and not lexicon.exceptions:
        return []
    best: dict[int, tuple[str, float]] = {}
    excused: list[tuple[int, int]] = []
    for end, (size, weight, term) in _automaton(lexicon.terms, lexicon.exceptions).iter(folded):
        start = end - size + 1
        if weight is None:
            excused.append((start, end))
        elif start not in best or best[start][1] < weight:
            best[start] = (term, weight)
    if not folded.isascii() and (general := _general(lexicon.terms)):
        for end, (size, weight, term) in _automaton(general, ()).iter(bare(folded)):
            start = end - size + 1
            if start not in best or best[start][1] < weight:
                best[start] = (term, weight)
    found, at = [], 0
    excused.sort()
    reach = -1
    for start in sorted(best):
        while at < len(excused) and excused[at][0] <= start:
            reach = max(reach, excused[at][1])
            at += 1
        if start >= reach:
            found.append((start, *best[start]))
    return found


def measures(folded: str, found: list[tuple[int, str, float]]) -> tuple[float, float, float]:
    """Mass of the matches, their mass by length (the square root of the words), and the log of the length; all 0 without a match."""
    n = max(folded.count(" ") - 1, 1)
    mass = sum(w for _, _, w in found)
    return (float(np.log1p(mass)), float(np.log1p(10 * mass / np.sqrt(n))), float(np.log1p(n)) / 10) if found else (0.0, 0.0, 0.0)


def fit_calibration(x: np.ndarray, y: np.ndarray, steps: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps with a small ridge."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    w[-1] = -3.0
    ridge = np.diag([1e-2] * x.shape[1] + [1e-4])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit_lexicon(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 12_000,
    starts: tuple[int, int] = (4, 9), least_docs: int = 6, least_ratio: float = 3.0,
) -> Lexicon:
    """Learn word starts and their weights from labelled rows: at most ``max_rows`` ids (a bounded sample, the first by a hash of the id).

    A start of a folded word counts once a document. Kept are those in ``least_docs`` toxic documents or more whose smoothed
    log-odds against other documents reach ``least_ratio``, all of them; a longer start gives way to a shorter one about as telling. The seed
    terms join with at least ``least_ratio``. Then the score is fitted on the same rows. Null ids, labels and texts are left
    out; of an id labelled twice the larger label counts. Without labelled rows of both kinds the seed alone scores. The driver gets
    the lexicon itself, which the sample bounds.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_rows)
    )
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    sample = materialize(source.join(F.broadcast(chosen), "id").select("y", "text"), "toxic-sample")
    lo, hi = starts

    def begun(toxic: bool):
        """Counts of the documents of one kind that have a word start."""

        def count(batches):
            seen: Counter = Counter()
            for batch in batches:
                for y, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                    if (y > 0) == toxic:
                        seen.update({w[:k] for w in set(fold(text).split()) for k in range(lo, min(hi, len(w)) + 1)})
            terms, n = list(seen), list(seen.values())
            for at in range(0, len(terms), 50_000):
                yield pa.RecordBatch.from_pydict({"term": pa.array(terms[at : at + 50_000], pa.string()), "n": pa.array(n[at : at + 50_000], pa.int64())})

        return map_batches(sample.select("y", "text"), count, "term string, n bigint")

    sizes = {r["y"] > 0: r["n"] for r in sample.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    seed = tuple((t, least_ratio) for t in SEED)
    if not n1 or not n0:
        return Lexicon(seed)
    # a start in few toxic documents goes before clean ones are counted, and what does not tell them apart before anything is collected
    toxic = materialize(begun(True).groupBy("term").agg(F.sum("n").alias("toxic")).where(F.col("toxic") >= least_docs), "toxic-starts")
    clean = begun(False).join(small_side(toxic.select("term")), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.coalesce("clean", F.lit(0)) + 0.5) / (n0 + 1))
    telling = toxic.join(clean, "term", "left").select("term", odds.alias("ratio")).where(F.col("ratio") >= least_ratio)
    ratio = {r["term"]: r["ratio"] for r in telling.collect()}
    kept: dict[str, float] = {}
    for t in sorted(ratio, key=lambda t: (len(t), t)):
        shorter = [kept[t[:k]] for k in range(lo, len(t)) if t[:k] in kept]
        if not shorter or ratio[t] > max(shorter) + 1.5:
            kept[t] = ratio[t]
    kept |= {t: max(r, kept.get(t, 0.0)) for t, r in seed}
    terms = tuple(sorted(kept.items()))
    plain = Lexicon(terms)

    def measure(batch: pa.RecordBatch) -> dict:
        got = [measures(f := fold(t), matches(f, plain)) for t in texts(batch.column(1))]
        return {"y": batch.column(0), **{f"f{k}": [g[k] for g in got] for k in range(3)}}

    rows = map_arrow(sample, measure, "y int, f0 double, f1 double, f2 double").groupBy((F.col("y") > 0).cast("int").alias("y"), "f0", "f1", "f2").agg(F.count("*").alias("n")).toArrow().to_pandas()
    rows = rows.sort_values(["y", "f0", "f1", "f2"]).reset_index(drop=True)
    rows = rows.loc[rows.index.repeat(rows["n"])]
    coefs, bias = fit_calibration(rows[["f0", "f1", "f2"]].to_numpy(), rows["y"].to_numpy(dtype=float))
    return Lexicon(terms, tuple(map(float, coefs)), bias)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the id, ``score`` (0 to 1), ``n_matches``, and ``terms``, the distinct matched terms in order.

    Only the text is read, whole; null is empty and scores as a text without a match. Null and repeated ids pass as they are.
    """
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> dict:
        scores, n, terms = [], [], []
        for text in texts(batch.column(1)):
            found = matches(folded := fold(text), lexicon)
            z = lexicon.bias + sum(c * f for c, f in zip(lexicon.coefs, measures(folded, found)))
            scores.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            n.append(len(found))
            terms.append(sorted({t for _, t, _ in found}))
        return {"id": batch.column(0), "score": scores, "n_matches": n, "terms": terms}

    out = map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, score double, n_matches bigint, terms array<string>")
    return out.withColumnRenamed("id", id_col)


THRESHOLD = 0.7


def held_out(id_col: str = "doc_id"):
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The score of each row of ``docs`` by a lexicon learned from the labelled rows that are not held out.

    A row for each row, whatever its id; null and empty texts score as texts without a match; without labels the seed scores.
    """
    lexicon = fit_lexicon(docs.where(~held_out()), labels.where(~held_out()))
    out = score_toxicity(docs, lexicon)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_matches", F.array_join("terms", ",").alias("terms"))
