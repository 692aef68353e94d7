"""Convolutional text classifier for toxicity (operator 9), trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import maybe_in
from .common import short_batches, spread, stored

#: Hash buckets of words, numbers in an embedding, filter widths in words and filters of each.
BUCKETS, DIMS, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 8
#: Labelled rows of each class that the model is fitted on, at most, and characters of a text that is fitted on.
MAX_ROWS, MAX_CHARS = 3000, 1 << 15
EPOCHS, BATCH = 10, 64
#: A bucket that fewer fitting rows hold has no embedding; log odds count from ODDS standard errors on.
MIN_ROWS, ODDS = 5, 2.0
#: A mark is a word that toxic fitting rows hold more often, or a beginning of STEMS letters of which other words show the same:
#: its log odds are STRONG or more after ODDS standard errors, and the likelihood ratio (G) against chance is SURE or
#: more. The surest MAX_MARKS of either kind are rows.
STEMS, STRONG, SURE, MAX_MARKS = (3, 4, 5, 6), 1.0, 24.0, 2048
#: Rows of the embedding: the buckets, one of zeros, and marks.
ROWS = BUCKETS + 1 + 2 * MAX_MARKS
#: Thresholds are multiples of 1 / BINS. A language with a RARE-th of the labelled rows or more has its own, for which
#: the errors over all languages count as PRIOR_ROWS of its rows; there can't be more than RARE such languages.
BINS, RARE, PRIOR_ROWS = 100, 1000, 50
#: Rows of words that a worker keeps at a time, and parts of words that it counts at a time.
CACHED_WORDS, COUNTED = 100_000, 200_000
_WORD = r"[^\W_]+"


def words(text: str | None) -> list[str]:
    """A text's lower-cased words."""
    import re

    return re.findall(_WORD, (text or "").lower())


def beginnings(word: str) -> list[str]:
    """A word's beginnings that may be marks, the longest first."""
    return [word[:n] for n in reversed(STEMS) if n <= len(word)]


def row_of(word: str, marks: dict) -> int:
    """A word's row of the embedding: its mark's, else that of its longest beginning that is a mark, else its bucket; a
    bucket that a mark has for itself is no other word's, and those have the row of zeros."""
    if marks:
        for part in (word + " ", *beginnings(word)):
            if part in marks:
                return marks[part]
    at = crc32(word.encode()) % BUCKETS
    return marks.get(at, at)


def placed(known: list[str], starts: list[str]) -> dict:
    """Rows of the words (keyed with a blank behind) and beginnings that are marks, the surest first. A word has its bucket for itself,
    unless a surer one has it; all else has a row behind the buckets."""
    marks: dict = {}
    for i, word in enumerate(known):
        at = crc32(word.encode()) % BUCKETS
        if at in marks:
            at = BUCKETS + 1 + i
        else:
            marks[at] = BUCKETS
        marks[word + " "] = at
    return marks | {part: BUCKETS + 1 + MAX_MARKS + i for i, part in enumerate(starts)}


def bucket_ids(text: str | None, cache: dict, marks: dict = {}) -> list[int]:  # noqa: B006  never written to
    """The rows of a text's words; a cache is for one set of marks."""
    found = words(text)
    try:
        return [cache[w] for w in found]
    except KeyError:
        if len(cache) > CACHED_WORDS:
            cache.clear()
        for w in found:
            if w not in cache:
                cache[w] = row_of(w, marks)
        return [cache[w] for w in found]


@dataclass
class Model:
    embedding: object
    filters: list
    out: object
    bias: float
    thresholds: dict
    threshold: float = 0.5
    marks: dict = field(default_factory=dict)

    def prepared(self):
        """For each width and place in it, the filters' answers to every row."""
        import numpy as np

        return [[np.ascontiguousarray(self.embedding @ w[j]) for j in range(len(w))] for w in self.filters]

    def score(self, ids, tables) -> float:
        """Probability of the toxic class for the rows of a text's words; windows reach over the ends by zeros."""
        import numpy as np

        pad = max(WIDTHS) - 1
        n = max(1, len(ids))
        ids = np.concatenate([np.asarray(ids, np.int64), np.full(n + pad - len(ids), BUCKETS)])
        pooled = []
        for table in tables:
            best = None
            for at in range(0, n, 4096):
                stop = min(n, at + 4096)
                act = table[0][ids[at:stop]]
                for j in range(1, len(table)):
                    act = act + table[j][ids[at + j : stop + j]]
                top = act.max(axis=0)
                best = top if best is None else np.maximum(best, top)
            pooled.append(best)
        z = float(np.maximum(np.concatenate(pooled), 0) @ self.out + self.bias)
        return float(1 / (1 + np.exp(-max(-60.0, min(60.0, z)))))


def train(rows: list[tuple], prior: float, seed: int = 7) -> Model:
    """Fit on (rows of words, label 0/1) by Adam. The first embedding number starts as the row's log odds
    between the classes, the rest at random; `prior` is the share of toxic rows among all labelled ones."""
    import numpy as np

    rng = np.random.default_rng(seed)
    pad = max(WIDTHS) - 1
    docs = [np.concatenate([np.asarray(ids, np.uint16), np.full(pad if len(ids) else pad + 1, BUCKETS, np.uint16)]) for ids, _ in rows]
    labels = np.array([y for _, y in rows], float)
    embedding = rng.normal(0, 0.1, (ROWS, DIMS)).astype(np.float32)
    filters = [rng.normal(0, 0.2, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] += 0.4 / len(f)
    out = np.full(FILTERS * len(WIDTHS), 0.1, np.float32)
    bias = np.zeros(1, np.float32)
    held = rng.random(len(docs)) < 0.15
    fit = np.flatnonzero(~held)
    if len(set(labels[fit])) < 2:
        p = min(max(prior, 1e-3), 1 - 1e-3)
        return Model(embedding, filters, out * 0, float(np.log(p / (1 - p))), {})
    seen = np.zeros((2, ROWS))
    for i in fit:
        seen[int(labels[i]), np.unique(docs[i])] += 1
    of = [(labels[fit] == c).sum() for c in (0, 1)]
    odds = [np.log((seen[c] + 0.5) / (of[c] - seen[c] + 0.5)) for c in (0, 1)]
    error = np.sqrt(sum(1 / (seen[c] + 0.5) + 1 / (of[c] - seen[c] + 0.5) for c in (0, 1)))
    gap = odds[1] - odds[0]
    embedding[:, 0] = np.sign(gap) * np.clip(np.abs(gap) - ODDS * error, 0, 3)
    blank = seen.sum(axis=0) < MIN_ROWS
    blank[BUCKETS] = True
    embedding[blank] = 0
    params = [embedding, *filters, out, bias]
    means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, lowest, kept = 0, np.inf, None
    for _ in range(EPOCHS):
        order = rng.permutation(fit)
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            pooled = np.zeros((len(batch), FILTERS * len(WIDTHS)), np.float32)
            places = np.zeros(pooled.shape, np.int64)
            for r, i in enumerate(batch):
                vectors = embedding[docs[i]]
                n = len(docs[i]) - pad
                for k, f in enumerate(filters):
                    act = sum(vectors[j : n + j] @ f[j] for j in range(len(f)))
                    best = act.argmax(axis=0)
                    own = slice(k * FILTERS, (k + 1) * FILTERS)
                    places[r, own], pooled[r, own] = best, act[best, np.arange(FILTERS)]
            live = np.maximum(pooled, 0)
            p = 1 / (1 + np.exp(-np.clip(live @ out + bias[0], -60, 60)))
            error = ((p - labels[batch]) / len(batch)).astype(np.float32)
            back = np.outer(error, out) * (pooled > 0)
            grads = [np.zeros_like(embedding), *[np.zeros_like(f) for f in filters], live.T @ error, np.array([error.sum()], np.float32)]
            for k, f in enumerate(filters):
                for c in range(FILTERS):
                    d, place = back[:, k * FILTERS + c], places[:, k * FILTERS + c]
                    for j in range(len(f)):
                        words = np.array([docs[i][q + j] for i, q in zip(batch, place)])
                        grads[1 + k][j, :, c] += d @ embedding[words]
                        np.add.at(grads[0], words, np.outer(d, f[j, :, c]))
            grads[0][blank] = 0
            step += 1
            rate = 0.005 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for q, g, m, v in zip(params, grads, means, squares):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                q -= rate * m / (np.sqrt(v) + 1e-8)
        model = Model(embedding, filters, out, float(bias[0]), {})
        tables = model.prepared()
        check = np.flatnonzero(held) if held.any() else fit
        p = np.clip([model.score(docs[i][: len(docs[i]) - pad], tables) for i in check], 1e-6, 1 - 1e-6)
        loss = -np.mean(np.where(labels[check] == 1, np.log(p), np.log(1 - p)))
        if loss < lowest:
            lowest, kept = loss, [q.copy() for q in params]
    embedding, *filters, out, bias = kept
    model = Model(embedding, filters, out, float(bias[0]), {})
    here = labels[fit].mean()
    p = min(max(prior, 1e-4), 1 - 1e-4)
    model.bias += float(np.log(p / (1 - p)) - np.log(here / (1 - here)))
    return model


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on labelled rows whose crc32(id as text) mod 5 is not 0, at most max_rows of each class with texts of at most
    MAX_CHARS characters: those with the least hash of their id. Only the rows of their words and the marks come to the driver.

    The thresholds by language come from all such labelled rows, each scored by a model that hasn't seen it: rows
    of the sample by one that was fitted on the other half of it, with that half's own marks. Null ids and labels teach nothing; an id that is labelled
    twice is toxic if either says so; of texts that repeat an id one is fitted on; without labels every text scores alike
    and nothing is rejected.
    """
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("k"), F.col("toxic").cast("int").alias("y")).where("k IS NOT NULL AND y IN (0, 1)").where(F.crc32(F.col("k").cast("string")) % 5 != 0)
    known = known.groupBy("k").agg(F.max("y").alias("y"))
    counts = dict(known.groupBy("y").count().collect())
    ordered = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(max_rows)
    sample = ordered(0).unionByName(ordered(1))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("k"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = texts.join(F.broadcast(sample), "k").where(F.coalesce(F.char_length("text"), F.lit(0)) <= MAX_CHARS)
    rows = rows.groupBy("k").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "y")).alias("r"))
    rows = spread(stored(rows.select("k", "r.text", "r.y", (F.crc32(F.concat(F.lit("half"), F.col("k").cast("string"))) % 2).cast("int").alias("half")), "sample"))
    short_batches(docs.sparkSession)
    # Marks of all rows, and of each half.
    every = marks_of(rows)

    def hashed(batches):
        import numpy as np
        import pyarrow as pa

        caches: list = [{} for _ in every]
        for b in batches:
            ids = lambda t, m: np.array(bucket_ids(t, caches[m], every[m]), "<u2").tobytes()
            texts, halves = b.column(1).to_pylist(), b.column(3).to_pylist()
            whole, own = [ids(t, 0) for t in texts], [ids(t, 1 + h) for t, h in zip(texts, halves)]
            yield pa.record_batch([b.column(0), pa.array(whole, pa.binary()), pa.array(own, pa.binary()), b.column(2), b.column(3)], names=["k", "ids", "own", "y", "half"])

    # Two bytes a word and set of marks: the driver holds the sample as it came.
    got = rows.mapInArrow(hashed, "k long, ids binary, own binary, y int, half int").toArrow()
    import numpy as np

    got = got.sort_by([("k", "ascending")])
    found, own = [[(np.frombuffer(i.as_buffer(), "<u2"), y) for i, y in zip(got.column(c), got.column("y").to_pylist())] for c in ("ids", "own")]
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    model = train(found, prior)
    model.marks = every[0]
    if total:
        half = dict(zip(got.column("k").to_pylist(), got.column("half").to_pylist()))
        blind = [train([r for r, h in zip(own, half.values()) if h != side], prior) for side in (0, 1)]
        for side in (0, 1):
            blind[side].marks = every[2 - side]
        model.threshold, model.thresholds = calibrated(texts, known, [*blind, model], half)
    return model


def marks_of(rows: DataFrame) -> list[dict]:
    """Marks with their rows of the embedding, as all rows (k, text, y, half) show them, those of half 0 and those of half 1. A
    beginning is for words that are no marks, so it is counted over these alone."""
    sizes = {(r.half, r.y): r["count"] for r in rows.groupBy("half", "y").count().collect()}
    n = [[float(sum(sizes.get((h, y), 0) for h in side)) for y in (0, 1)] for side in ((0, 1), (0,), (1,))]

    def sure(taken: list[set] | None) -> list[list[str]]:
        def counted(batches):
            import pyarrow as pa

            found: dict = {}

            def out():
                columns = [[p for p, _ in found], [s for _, s in found], *zip(*found.values())]
                types = (pa.string(), pa.int32(), pa.int64(), pa.int64())
                return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["part", "side", "clean", "toxic"])

            for b in batches:
                for t, y, h in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                    own = set(words(t.as_py()))
                    for side in (0, 1 + h):
                        for part in own if taken is None else {p for w in own - taken[side] for p in beginnings(w)}:
                            of = found.get((part, side))
                            if of is None:
                                of = found[part, side] = [0, 0]
                            of[y] += 1
                    if len(found) > COUNTED:
                        yield out()
                        found.clear()
            if found:
                yield out()

        counts = rows.mapInArrow(counted, "part string, side int, clean long, toxic long").groupBy("side", "part").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b")).where(F.col("a") + F.col("b") >= MIN_ROWS)
        n0, n1 = (F.element_at(F.array(*[F.lit(x[y]) for x in n]), F.col("side") + 1) for y in (0, 1))
        a, b = F.col("a"), F.col("b")
        x_log = lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)
        g = 2 * (x_log(a) + x_log(b) + x_log(n0 - a) + x_log(n1 - b) - x_log(a + b) - x_log(n0 + n1 - a - b) - x_log(n0) - x_log(n1) + x_log(n0 + n1))
        gap = F.ln((b + 0.5) / (n1 - b + 0.5)) - F.ln((a + 0.5) / (n0 - a + 0.5))
        error = F.sqrt(1 / (a + 0.5) + 1 / (n0 - a + 0.5) + 1 / (b + 0.5) + 1 / (n1 - b + 0.5))
        marks = stored(counts.select("side", "part", g.alias("g"), (gap - ODDS * error).alias("gap")).where((F.col("g") >= SURE) & (F.col("gap") >= STRONG)), "marks")
        return [[r.part for r in marks.where(F.col("side") == s).orderBy(F.desc("g"), "part").limit(MAX_MARKS).collect()] for s in range(3)]

    known = sure(None)
    return [placed(w, s) for w, s in zip(known, sure([set(w) for w in known]))]


def calibrated(texts: DataFrame, known: DataFrame, models: list, half: dict) -> tuple[float, dict]:
    """(threshold, thresholds by language) with the fewest errors over all texts (k, text, lang) that are known (k, y): a text
    whose id is in `half` is scored by models[half], every other one by the last model. Scores are counted by bin in
    Spark; ties go to the threshold nearest to a half."""
    import numpy as np

    shared = texts.sparkSession.sparkContext.broadcast(([vars(m) for m in models], half))

    def run(batches):
        import pyarrow as pa

        held, half = shared.value
        models = [Model(**m) for m in held]
        tables, caches = [m.prepared() for m in models], [{} for _ in models]
        for b in batches:
            use = [half.get(k, len(models) - 1) for k in b.column(0).to_pylist()]
            bins = [int(models[u].score(bucket_ids(t.as_py(), caches[u], models[u].marks), tables[u]) * BINS) for u, t in zip(use, b.column(1))]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(bins, pa.int32())], names=["k", "lang", "bin"])

    scored = maybe_in(texts, "k", known.select("k")).mapInArrow(run, "k long, lang string, bin int").join(known, "k")
    counts = stored(scored.groupBy("lang", "bin").agg(F.count_if(F.col("y") == 0).alias("clean"), F.count_if(F.col("y") == 1).alias("toxic")), "bins")
    total = counts.agg(F.sum(F.col("clean") + F.col("toxic"))).first()[0] or 0
    often = counts.groupBy("lang").agg(F.sum(F.col("clean") + F.col("toxic")).alias("n")).where((F.col("n") * RARE >= total) & F.col("lang").isNotNull()).select("lang")
    every = counts.groupBy("bin").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()
    own = counts.join(often, "lang").select("lang", "bin", "clean", "toxic").collect()

    def errors(rows):
        table = np.zeros((2, BINS + 1))
        for r in rows:
            table[:, r["bin"]] += r["clean"], r["toxic"]
        # At threshold bin b all clean texts from b on are wrong, and all toxic ones below it.
        return table[0].sum() - np.concatenate([[0], np.cumsum(table[0])[:-1]]) + np.concatenate([[0], np.cumsum(table[1])[:-1]])

    def best(wrong) -> float:
        return min(range(1, BINS), key=lambda b: (wrong[b], abs(b - BINS // 2))) / BINS

    overall = errors(every)
    share = overall / max(1, total)
    by_lang = {lang: best(errors([r for r in own if r["lang"] == lang]) + PRIOR_ROWS * share) for lang in sorted({r["lang"] for r in own})}
    return best(overall), by_lang


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs' id, language and score, and `rejected`: score at or over the threshold of the row's language.

    The score depends on the text alone. Null and empty texts get the score of no words; null ids and
    languages stay (a language without a threshold of its own takes that of all); repeated rows are scored again.
    """
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(vars(model))

    def run(batches):
        import pyarrow as pa

        model, cache = Model(**shared.value), {}
        tables = model.prepared()
        for b in batches:
            scores = [model.score(bucket_ids(t.as_py(), cache, model.marks), tables) for t in b.column(2)]
            cuts = [model.thresholds.get(x, model.threshold) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([s >= c for s, c in zip(scores, cuts)], pa.bool_())], names=["doc_id", "lang", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang string, score double, rejected boolean")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows that the model rejects; every other row as it was, with all its columns. Null and empty texts have the
    score of no words, repeated rows go or stay together, and no rows give no rows."""
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(vars(model))
    at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches):
        import pyarrow as pa

        model, cache = Model(**shared.value), {}
        tables = model.prepared()
        for b in batches:
            cuts = [model.thresholds.get(x, model.threshold) for x in b.column(lang_at).to_pylist()]
            yield b.filter(pa.array([model.score(bucket_ids(t.as_py(), cache, model.marks), tables) < c for t, c in zip(b.column(at), cuts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
