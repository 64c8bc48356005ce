"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.quality_fm import held_out
from rasterlake.llm.scratch import stage
from rasterlake.llm.tokens import lower_words, xxh64
from rasterlake.llm.words import BLOCK_BYTES, blocks, mix, split_words, text_buffer, windows

#: Words by kind, of four languages; those of a caller take their place. Lower case.
LEXICONS: dict[str, str] = {
    "insults": """idiot idiots moron morons imbecile imbeciles fool fools dimwit halfwit nitwit dunce dolt loser losers clown clowns coward cowards
      liar liars creep creeps jerk jerks weirdo freak freaks hypocrite scumbag bastard bastards wimp crybaby simpleton dumbass jackass asshole assholes
      idioten trottel depp deppen versager dummkopf feigling lügner arschloch schwachkopf vollidiot penner
      crétin crétins abruti abrutis imbécile imbéciles lâche menteur connard connards salaud bouffon ordure
      idiota idiotas imbécil imbéciles tonto tontos cobarde mentiroso payaso perdedor cabrón gilipollas""",
    "contempt": """stupid dumb pathetic worthless disgusting useless brainless clueless ignorant ridiculous laughable vile repulsive despicable contemptible
      hopeless spineless gutless shameful ugly hideous revolting loathsome miserable wretched incompetent inferior idiotic moronic foolish lame
      dumm wertlos ekelhaft erbärmlich widerlich nutzlos lächerlich hässlich abscheulich
      stupide pathétique dégoûtant dégoûtante inutile minable ridicule répugnant ignoble nul
      estúpido estúpida patético asqueroso inútil despreciable ridículo repugnante feo""",
    "dehumanising": """scum trash garbage filth vermin pest pests parasite parasites rat rats pig pigs swine dog dogs animal animals subhuman subhumans
      savage savages maggot maggots cockroach cockroaches leech leeches worm worms plague
      abschaum ungeziefer müll dreck schwein schweine ratte ratten
      racaille déchet déchets vermine porc porcs chien chiens
      escoria basura rata ratas cerdo cerdos perro perros gusano""",
    "threats": """kill killed die dies dead death hurt beat punch stab shoot hang burn destroy crush smash choke suffer bleed rot perish
      töten stirb sterben umbringen schlagen verrecke tuer meurs crève frapper brûler matar muere morir golpear quemar""",
    "vulgar": """crap shit bullshit piss pissed damn damned hell bloody arse ass fuck fucking fucked fucker sucks suck screw screwed
      scheiße verdammt kacke merde putain foutre chier mierda joder puta coño""",
    "hostile": """hate hates hated hating despise despises loathe loathes detest shut sick disgrace shame disgust contempt
      hasse hassen hass verachte haine déteste détester odio odiar detesto""",
}
#: Words for the person spoken to.
SECOND_PERSON = "you your yours yourself yourselves youre youve ur u ya thou thee thy du dich dir dein deine deinen deiner euch euer eure tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestra vuestro".split()
NEAR, WINDOW = 5, 20
#: Letters that digits and signs stand for.
_PLAIN = str.maketrans("013457@$!|+", "oieastasiit")
_NAMES = [*LEXICONS]
#: Counts of a text that add up over its parts.
_COUNTS = ("bytes", "words", "letters", "capitals", "digits", "marks", "exclaims", "asks", "repeats", "shouted", "second", "near", "shouted hits", "odd", "hidden hits", "spelt hits", "stretched", "learned", "learned weight", "learned near")
N_FEATURES = 2 * len(_NAMES) + 27
#: Bytes of the word beginnings that a learned lexicon knows, beside whole words; its entries at most; documents that an entry is in at least.
_BEGINNINGS, MOST_TERMS, LEAST_DOCS = (3, 4, 5, 6, 8), 4096, 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Lexicon:
    """Words of each kind, found by hash and then compared."""

    def __init__(self, kinds: dict[str, str], learned: tuple[np.ndarray, np.ndarray] | None = None):
        self.terms, self.weights = learned if learned is not None else (np.zeros(0, np.uint64), np.zeros(0))
        of = {}
        for i, words in enumerate(kinds.values()):
            for w in words.split():
                of.setdefault(w, i)
        for w in SECOND_PERSON:
            of.setdefault(w, -1)
        self.n_kinds = len(kinds)
        self.of = of
        items = [w.encode() for w in of]
        data = np.frombuffer(b"".join(items), np.uint8)
        ends = np.cumsum([len(w) for w in items])
        keys = xxh64(data, ends - np.array([len(w) for w in items]), ends)
        order = np.argsort(keys)
        self.keys, self.words, self.kind = keys[order], [items[i] for i in order], np.array([*of.values()])[order]
        self.longest = max(map(len, items))

    def learned(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The greatest weight of a word's learned terms; 0 without any."""
        best = np.zeros(len(s))
        if len(self.terms):
            for which, keys in _terms(raw, s, e):
                at = np.minimum(np.searchsorted(self.terms, keys), len(self.terms) - 1)
                hit = np.flatnonzero(self.terms[at] == keys)
                best[which[hit]] = np.maximum(best[which[hit]], self.weights[at[hit]])
        return best

    def find(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words raw[s:e] that are in the lexicon, and their entries."""
        some = np.flatnonzero(e - s <= self.longest)
        keys = xxh64(raw, s[some], e[some])
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == keys)
        ok = [i for i in hit.tolist() if raw[s[some[i]] : e[some[i]]].tobytes() == self.words[at[i]]]
        return some[ok], at[ok]

    def hides(self, word: str) -> bool:
        """Whether a word with digits, signs, stretched letters or stars in it stands for an entry that is no pronoun."""
        plain = re.sub(r"[._\-~^'’]", "", word.lower()).translate(_PLAIN)
        for w in (plain, re.sub(r"(.)\1+", r"\1", plain), re.sub(r"(.)\1{2,}", r"\1\1", plain)):
            if self.of.get(w, -1) >= 0:
                return True
        if "*" in plain and 3 < len(plain) <= self.longest and sum(c != "*" for c in plain) >= 2:
            like = re.compile(re.escape(plain).replace(r"\*", "."))
            return any(kind >= 0 and like.fullmatch(w) for w, kind in self.of.items())
        return False


def _terms(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of words raw[s:e]: which have a beginning of so many bytes, and its key; and the keys of whole words."""
    yield np.arange(len(s)), xxh64(raw, s, e)
    eight = np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), 0, (1,))
    for k in _BEGINNINGS:
        which = np.flatnonzero(e - s > k)
        yield which, mix((eight[s[which]] & np.uint64((1 << (8 * k)) - 1)) ^ mix(np.array([k], np.uint64)))


def _part(lexicon: Lexicon, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: counts, hits by entry, the most hits in a window and the greatest weight of a learned term, and the least distance of a hit to a second person."""
    n = len(at) - 1
    low, s, e, offsets = lower_words(raw, at)
    words = np.diff(offsets)
    rows = np.repeat(np.arange(n), words)
    total = np.concatenate([[0], np.cumsum(_LETTER[raw])]), np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))]), np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57))]), np.concatenate([[0], np.cumsum(_MARK[raw])])
    per_text = lambda t: t[at[1:]] - t[at[:-1]]
    where = lambda places: np.bincount(np.searchsorted(at, places, side="right") - 1, minlength=n)[:n]
    bang, ask = raw == 33, raw == 63
    twice = np.zeros(len(raw), bool)
    twice[1:] = (bang | ask)[1:] & (bang | ask)[:-1]
    caps = total[1][e] - total[1][s]
    shouted = (caps == e - s) & (e - s >= 3)

    found, entry = lexicon.find(low, s, e)
    kind = lexicon.kind[entry]
    second, hits, entry = found[kind < 0], found[kind >= 0], entry[kind >= 0]
    by_entry = np.zeros((n, len(lexicon.words)), np.int32)
    np.add.at(by_entry, (rows[hits], entry), 1)
    distance = np.full(len(hits), 10**6)
    if len(second):
        i = np.searchsorted(second, hits)
        for j in (np.clip(i - 1, 0, len(second) - 1), np.clip(i, 0, len(second) - 1)):
            same = rows[second[j]] == rows[hits]
            distance = np.where(same, np.minimum(distance, np.abs(second[j] - hits)), distance)
    least = np.full(n, 10**6)
    np.minimum.at(least, rows[hits], distance)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, rows[hits], np.searchsorted(hits, np.minimum(hits + WINDOW, offsets[rows[hits] + 1])) - np.arange(len(hits)))

    weight = lexicon.learned(low, s, e)
    known = np.flatnonzero(weight)
    strongest = np.zeros(n)
    np.maximum.at(strongest, rows[known], weight[known])
    close = np.full(len(known), False)
    if len(second) and len(known):
        i = np.searchsorted(second, known)
        for j in (np.clip(i - 1, 0, len(second) - 1), np.clip(i, 0, len(second) - 1)):
            close |= (rows[second[j]] == rows[known]) & (np.abs(second[j] - known) <= NEAR)

    # Odd words: digits or signs between letters, or a letter three times running.
    space = _SPACE[raw]
    begins = ~space
    begins[1:] &= space[:-1]
    cut = at[(at > 0) & (at < len(raw))]
    begins[cut] |= ~space[cut]
    a = np.flatnonzero(begins)
    b = np.append(a[1:], len(raw))
    letter_at = np.flatnonzero(_LETTER[raw])
    ends_of = np.zeros(len(raw) + 1, np.int64)
    ends_of[1:] = np.cumsum(space)
    inside = np.zeros(len(raw), bool)  # a sign or digit between two letters of one word
    if len(letter_at) > 1:
        gap = np.flatnonzero((np.diff(letter_at) > 1) & (np.diff(letter_at) < 5) & (ends_of[letter_at[1:]] == ends_of[letter_at[:-1]]))
        inside[letter_at[gap]] = True
    triple = np.zeros(len(raw), bool)
    triple[2:] = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & _LETTER[raw][2:] & (raw[2:] < 128)
    cum = lambda x: np.concatenate([[0], np.cumsum(x)])
    has, tri = (cum(x)[b] - cum(x)[a] > 0 for x in (inside, triple))
    text_of = np.searchsorted(at, a, side="right") - 1
    hidden = np.zeros(n, np.int64)
    view = raw.tobytes()
    for i in np.flatnonzero((has | tri) & (b - a <= 40)).tolist():
        word = view[a[i] : b[i]].decode("utf-8", "ignore").strip(" \t\n\v\f\r.,;:?\"'()[]{}<>")
        if 3 <= len(word) <= 24 and lexicon.hides(word.rstrip("!")):
            hidden[text_of[i]] += 1
    # Words spelt with spaces: four single letters running, and more.
    one = (e - s == 1) & _LETTER[low[s]] if len(s) else np.zeros(0, bool)
    spelt = np.zeros(n, np.int64)
    if one.any():
        edge = np.diff(np.concatenate([[0], (one & True).astype(np.int8), [0]]))
        for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if 4 <= j - i <= 16 and rows[i] == rows[j - 1] and lexicon.of.get(low[s[i:j]].tobytes().decode("ascii", "ignore"), -1) >= 0:
                spelt[rows[i]] += 1

    of = lambda mask: np.bincount(rows[mask], minlength=n)
    near = np.bincount(rows[hits[distance <= NEAR]], minlength=n)
    counts = np.column_stack([
        np.diff(at), words, *[per_text(t) for t in total], where(np.flatnonzero(bang)), where(np.flatnonzero(ask)), where(np.flatnonzero(twice)), of(shouted), np.bincount(rows[second], minlength=n), near,
        np.bincount(rows[hits[shouted[hits]]], minlength=n), np.bincount(text_of[has], minlength=n), hidden, spelt, np.bincount(text_of[tri], minlength=n),
        np.bincount(rows[known], minlength=n), np.bincount(rows[known], weight[known], n), np.bincount(rows[known[close]], minlength=n),
    ])
    return counts, by_entry, np.column_stack([most, strongest]), least


def features(lexicon: Lexicon, texts: pa.Array) -> np.ndarray:
    """A row of N_FEATURES numbers for each text; the densities are shares of words, in percent.

    A text of over 1 MB is taken in parts of about 1 MB that end at white space; whether a word is
    near another one is not looked at across such an end.
    """
    raw, at = text_buffer(texts)
    if len(texts) == 1 and len(raw) > BLOCK_BYTES:
        cuts = [0]
        while cuts[-1] < len(raw):
            end, look = min(cuts[-1] + BLOCK_BYTES, len(raw)), 1 << 16
            while end < len(raw) and not _SPACE[raw[end]]:
                spaces = np.flatnonzero(_SPACE[raw[end : end + look]])
                end = end + int(spaces[0]) if len(spaces) else min(end + look, len(raw))
            cuts.append(end)
        parts = [_part(lexicon, raw[a:b], np.array([0, b - a])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        c, by_entry = (np.sum([p[i] for p in parts], axis=0) for i in (0, 1))
        most, least = np.max([p[2] for p in parts], axis=0), np.min([p[3] for p in parts], axis=0)
    else:
        c, by_entry, most, least = _part(lexicon, raw, at)
    v = {name: c[:, i].astype(float) for i, name in enumerate(_COUNTS)}
    words, size, letters = np.maximum(v["words"], 1), np.maximum(v["bytes"], 1), np.maximum(v["letters"], 1)
    out = []
    for kind in range(lexicon.n_kinds):
        n = by_entry[:, lexicon.kind == kind].sum(axis=1)
        out += [100 * n / words, np.log1p(n)]
    hits = by_entry[:, lexicon.kind >= 0]
    out += [np.log1p(hits.sum(axis=1)), 100 * hits.sum(axis=1) / words, (hits > 0).sum(axis=1), most[:, 0], np.minimum(least, 50), 100 * v["near"] / words, np.log1p(v["near"]), 100 * v["second"] / words]
    out += [v["capitals"] / letters, v["shouted"] / words, v["shouted hits"], v["digits"] / size, v["marks"] / size, v["exclaims"] / words, v["asks"] / words, v["repeats"] / words]
    out += [100 * v["odd"] / words, np.log1p(v["hidden hits"]), np.log1p(v["spelt hits"]), 100 * v["stretched"] / words, np.log1p(v["words"]), v["bytes"] / words]
    out += [np.log1p(v["learned"]), 100 * v["learned"] / words, most[:, 1], np.log1p(v["learned weight"]), np.log1p(v["learned near"])]
    return np.column_stack(out)


def _marked(labels: DataFrame, label_col: str, label_id: str) -> DataFrame:
    """`id, label` of labelled ids that are not held out; of several labels the mean counts, rounded."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull() & ~held_out(F.col(label_id)))
    return marked.groupBy(F.col(label_id).alias("id")).agg(F.round(F.avg(F.col(label_col).cast("double"))).alias("label"))


def learn_lexicon(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = 12_000) -> tuple[np.ndarray, np.ndarray]:
    """Words and beginnings of words that are in far more texts of label 1 than chance allows: their keys, ascending, and weights.

    Counted over at most `most` labelled texts (the ids of least hash), of which near copies count
    once: of texts with the same least-hashed run of 5 words and the same label, one. A term counts once
    a text. It is taken if the binomial chance of as many texts of label 1 is below 1 in 150 after
    allowing for the number of terms, at most `MOST_TERMS`. Its weight is the logarithm of its odds over the usual ones.
    """
    chosen = F.broadcast(_marked(labels, label_col, id_col).orderBy(F.xxhash64("id"), "id").limit(most))  # at most `most` rows of 16 bytes
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id")
    kind = rows.schema["id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in blocks(batch.column(1)):
                hashes, _, _, offsets = split_words(*text_buffer(texts), lower=True)
                runs, row = windows(hashes, offsets, 5)
                least = np.full(len(texts), np.iinfo(np.int64).max)
                np.minimum.at(least, row, runs.view(np.int64))
                few = np.flatnonzero(np.diff(offsets) < 5)  # a shorter text is known by its words
                least[few] = [zlib.crc32(hashes[a:b].tobytes()) for a, b in zip(offsets[few], offsets[few + 1], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), batch.column(2).slice(start, len(texts)), pa.array(least)], names=["id", "label", "sketch"])

    once = rows.mapInArrow(sketch, f"id {kind}, label double, sketch long").groupBy("sketch", "label").agg(F.min("id").alias("id"))
    once = stage(once, "once")
    n, ones = once.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    nothing = np.zeros(0, np.uint64), np.zeros(0)
    if not ones or ones == n:
        return nothing

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, label = [np.zeros(0, np.uint64)], [np.zeros(0)]
        for batch in batches:
            for start, texts in blocks(batch.column(1)):
                low, s, e, offsets = lower_words(*text_buffer(texts))
                row = np.repeat(np.arange(len(texts)), np.diff(offsets))
                parts = [(row[which], k) for which, k in _terms(low, s, e)]
                r, k = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((k, r))
                r, k = r[order], k[order]
                new = np.ones(len(r), bool)
                new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
                keys.append(k[new])
                label.append(batch.column(2).slice(start, len(texts)).to_numpy(zero_copy_only=False)[r[new]])
        k, where, n_ = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n_), pa.array(np.bincount(where, np.concatenate(label), len(k)))], names=["term", "n", "ones"])

    mine = F.broadcast(once.select("id", "label"))  # at most `most` rows
    terms = rows.drop("label").join(mine, "id").select("id", "text", "label").mapInArrow(count, "term long, n long, ones double").groupBy("term").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    terms = stage(terms.where(F.col("n") >= LEAST_DOCS), "terms")
    base, chances = ones / n, max(1, terms.count())
    share, rest = F.col("ones") / F.col("n"), 1 - F.col("ones") / F.col("n")
    surprise = F.col("n") * (share * F.log(share / base) + F.when(rest > 0, rest * F.log(rest / (1 - base))).otherwise(0.0))
    good = terms.where(share > base).withColumn("surprise", surprise).where(F.col("surprise") >= float(np.log(chances) + 5))
    found = good.orderBy(F.desc("surprise"), "term").limit(MOST_TERMS).toArrow()  # at most MOST_TERMS rows
    if not found.num_rows:
        return nothing
    key = found["term"].to_numpy().view(np.uint64)
    n_, one = found["n"].to_numpy(), found["ones"].to_numpy()
    weight = np.log((one + 0.5) / (n_ - one + 0.5)) - np.log(base / (1 - base))
    order = np.argsort(key)
    return key[order], np.maximum(weight[order], 0.01)


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lexicons: dict[str, str] | None = None, learned: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """`id, features` of every whole text; null counts as empty. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicons or LEXICONS, learned))  # some 100 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*shared.value)
        for batch in batches:
            for start, texts in blocks(batch.column(1)):
                x = features(lexicon, texts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), lists], names=["id", "features"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, features array<double>")


#: Steps of a tree model's margin that calibration tells apart, and their number.
_STEP, _STEPS = 1 / 64, 512


class Classifier:
    """Trees and their calibration, or, where labels are missing or all alike, one score for all."""

    def __init__(self, trees=None, calibration=None, constant: float = 0.5):
        self.trees, self.calibration, self.constant = trees, calibration, constant

    def score(self, rows: DataFrame, features_col: str = "features", name: str = "score") -> DataFrame:
        if self.trees is None:
            return rows.withColumn(name, F.lit(float(self.constant)))
        out = self.calibration.transform(_margin(self.trees.transform(rows.withColumn("__x", array_to_vector(features_col)))))
        return out.withColumn(name, F.least(F.greatest(F.col("__score"), F.lit(0.0)), F.lit(1.0))).drop("__x", "__raw", "__p", "__y", "__margin", "__score")


def _margin(rows: DataFrame) -> DataFrame:
    steps = F.round(F.element_at(vector_to_array("__raw"), 2) / F.lit(_STEP))
    return rows.withColumn("__margin", F.least(F.greatest(steps, F.lit(-float(_STEPS))), F.lit(float(_STEPS))) * F.lit(_STEP))


def fit(rows: DataFrame, labels: DataFrame, label_col: str = "toxic", label_id: str = "doc_id", trees: int = 25, depth: int = 4, rate: float = 0.25, task_rows: int = 20_000) -> Classifier:
    """Trains on the labelled rows of `described` that are not held out, all of them.

    One row in four (by the CRC-32 of the id) calibrates: isotonic regression of the label on the trees' margin,
    rounded to one of 1,025 steps and counted by step first. The others grow the trees.
    """
    rows = stage(rows.join(_marked(labels, label_col, label_id), "id").withColumn("fold", F.crc32(F.col("id").cast("string").cast("binary")) % 5), "labelled")
    n, mean, low, high = rows.agg(F.count(F.lit(1)), F.avg("label"), F.min(F.when(F.col("fold") != 1, F.col("label"))), F.max(F.when(F.col("fold") != 1, F.col("label")))).first()
    if not n or low is None or low == high:
        return Classifier(constant=mean if mean is not None else 0.5)
    rows = rows.select("id", "label", "fold", array_to_vector("features").alias("__x"))
    grown = rows.where("fold <> 1").coalesce(max(1, n // task_rows)).sortWithinPartitions("id")
    grower = GBTClassifier(featuresCol="__x", labelCol="label", predictionCol="__y", maxIter=trees, maxDepth=depth, stepSize=rate, maxBins=64, minInstancesPerNode=5, seed=11)
    model = grower.setRawPredictionCol("__raw").setProbabilityCol("__p").fit(grown)
    steps = _margin(model.transform(rows.where("fold = 1"))).groupBy("__margin").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    steps = stage(steps, "steps").coalesce(1)  # 1,025 rows at most
    if not steps.limit(1).count():
        steps = _margin(model.transform(grown)).groupBy("__margin").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    calibration = IsotonicRegression(featuresCol="__margin", labelCol="label", weightCol="weight", predictionCol="__score").fit(steps)
    return Classifier(model, calibration)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", lexicons: dict[str, str] | None = None, **training) -> DataFrame:
    """Trains, then returns id, `held_out`, `score` (0 to 1) and `predicted` (1 where the score is at least `threshold`) per input row.

    Of several labels for an id the mean counts, rounded; null labels and ids are left out. The
    densities are those of the given lexicons and of one learned from labelled texts (`learn_lexicon`).
    Null and empty texts are scored by their features like others; repeated rows get equal scores; a
    null id is never trained on or held out. Without labels every score is 1/2, and with labels of one kind only, that
    label. Other columns of `docs` play no part.
    """
    learned = learn_lexicon(docs, labels, label_col, id_col, text_col)
    rows = stage(described(docs, id_col, text_col, lexicons, learned), "features")
    scored = fit(rows, labels, label_col, id_col, **training).score(rows)
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
