"""Papers matched to table rows: pairs that share enough, weighted score with floors, outcome, conflicts.

Words and names of templates stand in nearly every title of a table, so pairs are not made by a join on them:
the rows of a tile form one inverted index of bytes, against which its papers are counted and scored at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marginalia.functions import names as nm
from marginalia.functions import values as v
from marginalia.operators.order import numbered
from marginalia.session import saved, shared_dir

# Weights, threshold and gap of the matching score.
DOI_WEIGHT, TITLE_WEIGHT, FIRST_AUTHOR_WEIGHT, AUTHOR_WEIGHT, YEAR_WEIGHT, EXACT_TITLE_BONUS = 0.45, 0.30, 0.15, 0.10, 0.10, 0.15
LEAST, GAP = 0.35, 0.15
#: What the same title scores at least.
SAME_TITLE = 0.62
#: Two titles meet by their words alone if one word in so many of both is common; what is less alike and shares no author near its year stays far below the threshold.
LIKE = 3
#: Rows in one index, papers that are worth a tile of their own, cells looked at in one step, words of an index that have a vector of all its rows.
TILE_ROWS, TILE_PAPERS, CELLS, VECTORS = 65_536, 256, 1 << 20, 512


def features(df: DataFrame, key: str, title: str, authors: str, year: str, doi: str, prefix: str, link: str | None = None) -> DataFrame:
    """Comparable forms of a paper or row. Null and blank fields give null or an empty list."""
    p = prefix
    own = f"coalesce({nm.doi(doi)}, {nm.doi_in(link)})" if link else nm.doi(doi)
    return df.withColumn("__plain", F.expr(nm.plain(title))).select(
        F.col(key).alias(f"{p}_id"), F.expr(own).alias(f"{p}_doi"), F.expr("nullif(__plain, '')").alias(f"{p}_norm"), F.expr(nm.split_words("__plain")).alias(f"{p}_title"),
        F.expr(nm.family_names(authors)).alias(f"{p}_names"), F.expr(nm.family_name(authors)).alias(f"{p}_first"), F.expr(nm.year(year)).alias(f"{p}_year"),
    )


def _fields(p: str) -> list[str]:
    return [f"{p}_{x}" for x in ("doi", "norm", "title", "names", "first", "year")]


def distinct_forms(df: DataFrame, p: str) -> DataFrame:
    """One row per combination of features: the least id stands for it, with the number of ids."""
    return df.groupBy(*_fields(p)).agg(F.min(f"{p}_id").alias(f"{p}_id"), F.count_distinct(f"{p}_id").alias(f"{p}_n"))


class _Lists:
    """The lists of a column as sizes, offsets and codes into the values of an index (-1: not among them)."""

    def __init__(self, column: pa.Array, values: pa.Array):
        self.size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.code = _codes(column.flatten(), values, -1)


class _Index:
    """Where each value of a list column stands, once as vectors of all rows for the most frequent values."""

    def __init__(self, column: pa.Array):
        self.values = column.flatten().unique()
        lists = _Lists(column, self.values)
        n, self.size = len(column), lists.size
        parent = np.repeat(np.arange(n), lists.size)
        self.rows = parent[np.argsort(lists.code, kind="stable")]
        count = np.bincount(lists.code, minlength=len(self.values))
        self.at = np.concatenate([[0], np.cumsum(count)])
        # Counts never reach the largest number of their type, which so stands for all that is out of reach
        most = int(lists.size.max(initial=0))
        self.type = np.uint8 if most < 255 else np.uint16 if most < 65_535 else np.uint32
        hot = np.argsort(-count, kind="stable")[:VECTORS]
        hot = hot[count[hot] * 32 > n]
        self.vector = np.full(len(self.values), -1)
        self.vector[hot] = np.arange(len(hot))
        self.vectors = np.zeros((len(hot), n), np.uint8)
        for i, c in enumerate(hot):
            self.vectors[i, self.rows[self.at[c] : self.at[c + 1]]] = 1

    def having(self, codes: np.ndarray) -> np.ndarray:
        """Rows with any of the codes, those with several of them as often."""
        return np.concatenate([self.rows[self.at[c] : self.at[c + 1]] for c in codes if c >= 0])

    def count(self, codes: np.ndarray, into: np.ndarray) -> None:
        """Adds to each row how many of the codes it has."""
        for c in codes:
            if c < 0:
                continue
            if (k := self.vector[c]) >= 0:
                np.add(into, self.vectors[k], out=into)
            else:
                into[self.rows[self.at[c] : self.at[c + 1]]] += 1


def _codes(column: pa.Array, values: pa.Array, none: int) -> np.ndarray:
    return pc.fill_null(pc.index_in(column, value_set=values, skip_nulls=True), none).to_numpy(zero_copy_only=False).astype(np.int64)


def _years(column: pa.Array, none: int) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), none).to_numpy(zero_copy_only=False)


class _Tile:
    """Rows of one tile in the order of their ids, against which papers are scored."""

    def __init__(self, rows: pa.Table):
        column = lambda c: rows.column(c).combine_chunks()
        self.n, self.ids, self.alike = rows.num_rows, column("r_id"), column("n").to_numpy()
        self.title, self.names = _Index(column("title")), _Index(column("names"))
        self.words, self.years = column("title"), column("year")
        self.year = _years(self.years, -1_000_000)
        self.same = {c: (u := column(c).unique().drop_null(), _codes(column(c), u, -1)) for c in ("doi", "norm", "first")}
        values, code = self.same["doi"]
        self.with_doi = np.argsort(code, kind="stable")
        self.doi_at = np.searchsorted(code[self.with_doi], np.arange(len(values) + 1))
        self.least: dict[int, np.ndarray] = {}

    def _least(self, size: int) -> np.ndarray:
        """Common words that a title of so many words must have with each row's: a third of all words of both."""
        if size not in self.least:
            if len(self.least) >= 64:
                self.least.clear()
            need = np.maximum(-(-(size + self.title.size) // (LIKE + 1)), 1)
            self.least[size] = np.minimum(need, np.iinfo(self.title.type).max).astype(self.title.type)
        return self.least[size]

    def met(self, papers: pa.RecordBatch, best: int | None) -> Iterator[list[pa.Array]]:
        """Ids of papers and rows that meet, score, rows alike; with ``best`` only the best so many of each paper,
        with title and year of the row, and with the first of them the number of all the paper's rows."""
        title, names = (_Lists(papers.column(c), x.values) for c, x in (("title", self.title), ("names", self.names)))
        year, ids = _years(papers.column("year"), 1_000_000), papers.column("p_id")
        same = {c: _codes(papers.column(c), u, -2) for c, (u, _) in self.same.items()}
        step = max(1, CELLS // self.n)
        common, shared = np.zeros((step, self.n), self.title.type), np.zeros((step, self.n), self.names.type)
        meets = np.zeros((step, self.n), bool)
        for start in range(0, papers.num_rows, step):
            k = min(step, papers.num_rows - start)
            common[:k], shared[:k] = 0, 0
            for i, p in enumerate(range(start, start + k)):
                self.title.count(title.code[title.at[p] : title.at[p + 1]], common[i])
                np.greater_equal(common[i], self._least(title.size[p]), out=meets[i])
                if (who := names.code[names.at[p] : names.at[p + 1]]).max(initial=-1) >= 0:
                    self.names.count(who, shared[i])
                    near = self.names.having(who)
                    meets[i, near[np.abs(self.year[near] - year[p]) <= 1]] = True
                if (c := same["doi"][p]) >= 0:
                    meets[i, self.with_doi[self.doi_at[c] : self.doi_at[c + 1]]] = True
            flat = np.flatnonzero(meets[:k])
            if not len(flat):
                continue
            of = flat // self.n
            row, paper = flat - of * self.n, of + start
            equal = {c: (same[c][paper] == x[row]).astype(float) for c, (_, x) in self.same.items()}
            score = scores(
                equal["doi"], equal["norm"], equal["first"], np.abs(self.year[row] - year[paper]), common.ravel()[flat].astype(float),
                title.size[paper], self.title.size[row], shared.ravel()[flat].astype(float), names.size[paper],
            )
            if best is None:
                yield [ids.take(pa.array(paper)), self.ids.take(pa.array(row)), pa.array(score / 1e6), pa.array(self.alike[row])]
                continue
            first = np.flatnonzero(np.diff(of, prepend=-1))
            each, whose = np.diff(first, append=len(of)), paper[first]
            total = np.add.reduceat(self.alike[row], first)
            key = score.astype(np.int64) * self.n + (self.n - 1 - row)  # ties: the least id
            for place in range(best):
                top = np.maximum.reduceat(key, first)
                left = top >= 0
                at = self.n - 1 - top[left] % self.n
                yield [ids.take(pa.array(whose[left])), self.ids.take(pa.array(at)), pa.array((top[left] // self.n) / 1e6), pa.array(self.alike[at]), self.words.take(pa.array(at)), self.years.take(pa.array(at)), pa.array(total[left] if place == 0 else np.zeros(len(at), np.int64))]
                key[key == np.repeat(top, each)] = -1


def scores(doi, exact, first, apart, common, p_size, r_size, shared, n_names) -> np.ndarray:
    """Scores of pairs in millionths, from 0/1 for the same DOI, title and first author, years apart, and counts of words and names."""
    shortest = np.minimum(p_size, r_size)
    some = shortest > 0
    title = np.where(some, common / np.maximum(p_size + r_size - common, 1), 0.0)
    inside = np.where(some, common / np.maximum(shortest, 1), 0.0)
    year = np.where(apart == 0, 1.0, np.where(apart == 1, 0.5, 0.0))
    overlap = shared / np.maximum(n_names, 1)
    weighted = DOI_WEIGHT * doi + TITLE_WEIGHT * title + EXACT_TITLE_BONUS * exact + YEAR_WEIGHT * year + FIRST_AUTHOR_WEIGHT * first + AUTHOR_WEIGHT * overlap
    conflict = some & (title < 0.4) & (inside < 0.6)
    floor = np.select(
        [(doi == 1) & ~conflict, title >= 0.999, (shortest >= 6) & ((title >= 0.85) | (inside >= 0.9)), (title >= 0.75) & (year == 1)],
        [0.95, np.where(year == 1, 0.70, np.where(year > 0, 0.66, SAME_TITLE)), 0.68, 0.60], 0.0,
    )
    known = np.where((first == 1) & (overlap > 0) & (year == 1) & (title >= 0.4), 0.80, 0.0)
    return np.floor(np.minimum(np.maximum(np.maximum(weighted, floor), known), 1.0) * 1e6 + 0.5)


def _meetings(p: DataFrame, r: DataFrame, best: int | None = None) -> DataFrame:
    """Scored pairs of the stored forms ``p`` and ``r``.

    Rows are dealt by their ids to tiles of about ``TILE_ROWS``, papers to as many shares as give every core work; each
    row goes to all shares, each paper to all tiles, and no task holds more than the rows of its tile.
    """
    tiles = max(1, -(-r.count() // TILE_ROWS))
    shares = max(1, min(-(-p.count() // TILE_PAPERS), -(-2 * p.sparkSession.sparkContext.defaultParallelism // tiles)))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    whole = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    fields = lambda k: [F.col(f"{k}_{x}").alias(x) for x in ("doi", "norm", "title", "names", "first", "year", "n")]
    rows = r.select(part("r_id", tiles).alias("tile"), whole(shares).alias("share"), F.lit(0).alias("side"), F.lit(None).cast(p.schema["p_id"].dataType).alias("p_id"), "r_id", *fields("r"))
    papers = p.select(whole(tiles).alias("tile"), part("p_id", shares).alias("share"), F.lit(1).alias("side"), "p_id", F.lit(None).cast(r.schema["r_id"].dataType).alias("r_id"), *fields("p"))
    dealt = rows.unionByName(papers).withColumn("part", F.col("tile") * shares + F.col("share")).drop("tile", "share")
    placed = dealt.repartitionById(tiles * shares, "part").sortWithinPartitions("part", "side", F.asc_nulls_last("r_id"))
    more = [r.schema["r_title"], r.schema["r_year"], T.StructField("n", T.LongType())] if best is not None else []
    schema = T.StructType([p.schema["p_id"], r.schema["r_id"], T.StructField("score", T.DoubleType()), T.StructField("r_n", T.LongType()), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, tile = None, [], None
        for batch in batches:
            parts, sides = batch.column("part").to_numpy(), batch.column("side").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(parts) != 0) | (np.diff(sides) != 0)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if parts[a] != part:
                    part, rows, tile = parts[a], [], None
                piece = batch.slice(a, b - a)
                if sides[a] == 0:
                    rows.append(piece)
                    continue
                if rows and tile is None:
                    tile, rows = _Tile(pa.Table.from_batches(rows)), []
                if tile is not None:
                    for columns in tile.met(piece, best):
                        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return placed.mapInArrow(run, schema)


def candidate_pairs(papers: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of forms that share a DOI, a family name in the same year or one beside it, or a third of their title words.

    Never a cross join: forms without a DOI, names and a title meet nothing.
    """
    return score_pairs(papers, rows).select("p_id", "r_id")


def score_pairs(papers: DataFrame, rows: DataFrame, best: int | None = None) -> DataFrame:
    """Scored pairs of distinct forms (see :func:`distinct_forms`): ``p_id``, ``r_id``, ``score``, and ``r_n`` rows alike.

    All pairs that share a DOI, a family name within a year, or a third of their title words; others are no rivals.
    With ``best`` at least so many of the best of each paper, ties by ``r_id``, and ``n``, whose sum is the number of
    rows of all its pairs."""
    return _meetings(*_stored((distinct_forms(papers, "p"), "paper-forms"), (distinct_forms(rows, "r"), "row-forms")), best)


def _stored(*tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """Tables that don't need each other, stored at the same time: either alone leaves cores idle."""
    shared_dir(tables[0][0].sparkSession)  # named before the threads ask for it
    with ThreadPoolExecutor(len(tables)) as pool:
        return list(pool.map(lambda t: saved(*t), tables))


def _near_duplicate(a: str, b: str) -> str:
    """Two rows that describe one paper: titles of likeness 0.85 or more, and the same year."""
    return f"size({a}.title) > 0 and size({b}.title) > 0 and {a}.year = {b}.year and size(array_intersect({a}.title, {b}.title)) / size(array_union({a}.title, {b}.title)) >= 0.85D"


def _form_outcomes(p: DataFrame, r: DataFrame, least: float, gap: float) -> DataFrame:
    """Of each form of papers, which stands for ``p_n`` of them, the fields of :func:`outcomes`; ``p`` and ``r`` are stored forms.

    Two rows of a paper leave each tile, with their titles and years, so a form is gathered from as many rows as there are tiles, twice.
    """
    found = F.struct((-F.col("score")).alias("less"), F.col("r_id").isNull().alias("none"), "r_id", "r_n", F.col("r_title").alias("title"), F.col("r_year").alias("year"))
    best = _meetings(p, r, best=2).groupBy("p_id").agg(F.sort_array(F.collect_list(found)).alias("best"), F.sum("n").alias("n_candidates"))
    two = best.select("p_id", F.get("best", F.lit(0)).alias("f1"), F.get("best", F.lit(1)).alias("f2"), "n_candidates")
    two = two.withColumn("twin", F.expr(f"case when f1.r_n > 1 then size(f1.title) > 0 and f1.year is not null else coalesce({_near_duplicate('f1', 'f2')}, false) end"))
    two = two.selectExpr("p_id", "f1.r_id", "-f1.less as score", "case when f1.r_n > 1 then -f1.less else coalesce(-f2.less, 0D) end as runner_up", "twin", "n_candidates")
    out = p.join(two, "p_id", "left").na.fill(0.0, ["score", "runner_up"]).na.fill(0, ["n_candidates"]).na.fill(False, ["twin"]).withColumn("gap", F.expr(v.round6("score - runner_up")))
    out = out.withColumn("outcome", F.expr(f"case when score < {least} then 'unmatched' when gap < {gap} and not twin then 'ambiguous' else 'matched' end"))
    out = saved(out.select("p_n", *_fields("p"), F.when(F.col("outcome") != "unmatched", F.col("r_id")).alias("r_id"), "score", "gap", "n_candidates", "outcome"), "match-forms")  # read twice: scored once
    claims = out.where("outcome = 'matched'").groupBy("r_id").agg(F.sum("p_n").alias("claims"))
    return out.join(claims, "r_id", "left").withColumn("outcome", F.when((F.col("outcome") == "matched") & (F.col("claims") > 1), "conflict").otherwise(F.col("outcome"))).drop("claims")


def _counted_forms(papers: DataFrame) -> DataFrame:
    """Forms of papers with the number of papers, ids that are missing or come twice included."""
    return papers.groupBy(*_fields("p")).agg(F.min("p_id").alias("p_id"), F.count("*").alias("p_n"))


def outcomes(papers: DataFrame, rows: DataFrame, least: float = LEAST, gap: float = GAP) -> DataFrame:
    """Best row of each paper, score, gap to the runner-up, and the outcome; rows that two papers claim are conflicts.

    Alike papers and alike rows are matched once: rows of the same features count as their own runner-up, which is
    a near duplicate and so no rival (the least id is taken) unless title or year is missing. A paper without a
    candidate has score 0; without a rival its runner-up is 0. Only the two best candidates are kept, before the shuffle.
    """
    papers, r = _stored((papers, "papers"), (distinct_forms(rows, "r"), "row-forms"))  # names and titles are taken apart once
    forms = _form_outcomes(saved(_counted_forms(papers), "paper-forms"), r, least, gap)
    return papers.join(forms, _null_safe(papers, forms, _fields("p")), "left").select("p_id", "r_id", "score", "gap", "n_candidates", "outcome")


def outcome_counts(papers: DataFrame, rows: DataFrame, least: float = LEAST, gap: float = GAP) -> DataFrame:
    """Papers of each outcome of :func:`outcomes`, and those with a row: counted by forms, so no paper is sought again."""
    forms = _form_outcomes(*_stored((_counted_forms(papers), "paper-forms"), (distinct_forms(rows, "r"), "row-forms")), least, gap)
    return forms.groupBy("outcome").agg(F.sum("p_n").alias("n"), F.sum(F.when(F.col("r_id").isNotNull(), F.col("p_n")).otherwise(0)).alias("with_row"))


def unmatched(papers: DataFrame, rows: DataFrame, least: float = LEAST) -> DataFrame:
    """Ids of the papers that :func:`outcomes` calls unmatched: no row scores ``least``.

    A row with the same DOI or title scores that much by itself, so papers that have one are left out by joins; of the
    others only the best row in each tile is needed, neither runner-up nor claims.
    """
    papers, r = _stored((papers, "papers"), (distinct_forms(rows, "r"), "row-forms"))
    rest = _counted_forms(papers)
    for c, scored in (("doi", DOI_WEIGHT), ("norm", SAME_TITLE)):
        if scored >= least:
            known = r.where(f"r_{c} is not null").select(F.col(f"r_{c}").alias("known")).distinct()
            rest = rest.join(known, (rest[f"p_{c}"] == known["known"]) & rest["p_id"].isNotNull(), "left_anti")
    p = saved(rest, "open-forms")
    found = _meetings(p, r, best=1).where(F.col("score") >= least).select("p_id").distinct()
    without = p.join(found, "p_id", "left_anti").select(*_fields("p"))
    return papers.join(without, _null_safe(papers, without, _fields("p")), "left_semi").select("p_id")


def _null_safe(a: DataFrame, b: DataFrame, columns: list[str]):
    on = a[columns[0]].eqNullSafe(b[columns[0]])
    for c in columns[1:]:
        on = on & a[c].eqNullSafe(b[c])
    return on


def best_candidates(scored: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best rows of each paper with their rank; the rest go before the shuffle."""
    w = Window.partitionBy("p_id").orderBy(F.desc("score"), "r_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("p_id", "rank", "r_id", "score")


def append_unmatched(matched: DataFrame, start: int) -> DataFrame:
    """New row indices for papers without a row, after ``start``, in the order of their ids."""
    return append_papers(matched.where("outcome = 'unmatched'").select("p_id"), start)


def append_papers(ids: DataFrame, start: int) -> DataFrame:
    """New row indices for the papers of these ids, see :func:`unmatched`, after ``start``, in their order."""
    return numbered(ids, "p_id", number="row_index", start=start + 1)
