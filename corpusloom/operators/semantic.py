"""Term weights, cosine similarity and clusters of files, for each repository by itself.

Weights are (1 + ln tf) * (1 + ln(N / df)), scaled to length one, over the terms
of highest document frequency. Files with the same terms are one. Their cosines
are products of blocks of files, so that what is moved grows with the files and
the blocks of their repository, not with the pairs that share a term.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.identifiers import split_identifier
from corpusloom.operators.corpus import row_key
from corpusloom.session import durable, release

VOCABULARY = 5000
#: Files of a block whose cosines with another block are one product.
BLOCK_FILES = 2048
#: Blocks by as many blocks whose links are thinned out as one.
FOREST_BLOCKS = 16
#: Pairs or links of a repository up to which its parts at all limits are found in one task.
TASK_LINKS = 2_000_000
#: Cosine limits among which each repository gets the one that suits it.
LIMITS = [x / 100 for x in range(30, 71, 5)]
#: Repositories whose counts are broadcast.
BROADCAST_ROWS = 100_000


def file_tokens(files: DataFrame, symbols: DataFrame, imports: DataFrame, exports: DataFrame | None = None, comments: DataFrame | None = None) -> DataFrame:
    """(repo, path, term, tf): the words of each file's path, symbols with their parents, import sources and imported names.

    Where they are given, also of its exports (repo, path, name) and marker comments (repo, path, text).
    """
    named = symbols.select("repo", "path", F.explode(F.array("name", F.coalesce("parent_symbol", F.lit("")))).alias("name"))
    sources = imports.select("repo", "path", F.col("source").alias("name"))
    members = imports.select("repo", "path", F.explode("symbols").alias("name"))
    names = files.select("repo", "path", F.col("path").alias("name")).unionByName(named).unionByName(sources).unionByName(members)
    if exports is not None:
        names = names.unionByName(exports.select("repo", "path", "name"))
    if comments is not None:
        names = names.unionByName(comments.select("repo", "path", F.col("text").alias("name")))
    # brought to the live files before they are split, so that the counts need no shuffle of their own
    live = names.filter("name is not null").join(files.select("repo", "path"), ["repo", "path"], "left_semi")
    words = live.select("repo", "path", F.explode(split_identifier(F.col("name"))).alias("term"))
    return words.groupBy("repo", "path", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(tokens: DataFrame) -> DataFrame:
    """(repo, term, df)."""
    return tokens.groupBy("repo", "term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(tokens: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """(repo, term, df): the ``size`` terms of highest document frequency of each repository, ties by term."""
    order = Window.partitionBy("repo").orderBy(F.desc("df"), "term")
    return document_frequency(tokens).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= size).drop("r")


def tfidf(tokens: DataFrame, files: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """(repo, path, term, weight) of length one for each file; files without terms count in N and have no rows."""
    count = files.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    raw = tokens.join(vocabulary(tokens, size), ["repo", "term"]).join(count, "repo").withColumn("w", (1 + F.log("tf")) * (1 + F.log(F.col("n") / F.col("df"))))
    # a window moves the weights once, a join with their sums would make and move them twice
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("repo", "path")))
    return raw.select("repo", "path", "term", (F.col("w") / norm).alias("weight"))


def file_terms(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(repo, path, v): the words of each file that ``file_tokens`` counts, as one array of (term, tf).

    ``symbols`` and ``imports`` may repeat rows. Only the names move, with a hash of
    their row, and once: what tells repeated rows, live files and words apart comes
    after, by file.
    """
    rows = files.select("repo", "path", F.array("path").alias("names"), F.lit(0).cast("long").alias("row"))
    rows = rows.unionByName(symbols.select("repo", "path", F.array("name", "parent_symbol").alias("names"), row_key(symbols).alias("row")))
    rows = rows.unionByName(imports.select("repo", "path", F.concat(F.array("source"), F.coalesce("symbols", F.array().cast("array<string>"))).alias("names"), row_key(imports).alias("row")))
    once = rows.filter("repo is not null and path is not null").repartition("repo", "path").distinct()
    live = once.join(files.select("repo", "path"), ["repo", "path"], "left_semi").select("repo", "path", F.explode("names").alias("name"))
    words = live.filter("name is not null").select("repo", "path", F.explode(split_identifier(F.col("name"))).alias("term"))
    counted = words.groupBy("repo", "path", "term").agg(F.count(F.lit(1)).alias("tf"))
    return counted.groupBy("repo", "path").agg(F.collect_list(F.struct("term", "tf")).alias("v"))


def file_vectors(terms: DataFrame, files: DataFrame, size: int = VOCABULARY, block_files: int = BLOCK_FILES) -> tuple[DataFrame, DataFrame]:
    """(repo, path, same, v), written: the weights of ``tfidf`` as one array of (term, weight) for each file and the file that stands for it, as in ``same_terms``; and (repo, files), how many have terms.

    Takes ``file_terms``. The vocabulary of a repository comes to its files, block by
    block, so that words are not moved on their own.
    """
    terms = durable(terms)
    counts = durable(terms.groupBy("repo").agg(F.count(F.lit(1)).alias("files")))
    listed = vocabulary(terms.select("repo", "path", F.explode("v.term").alias("term")), size).groupBy("repo").agg(F.collect_list(F.struct("term", "df")).alias("words"))
    known = durable(listed.join(files.groupBy("repo").agg(F.count(F.lit(1)).alias("n")), "repo"))
    blocks = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    blocks = blocks.select("repo", F.ceil(F.col("files") / block_files).cast("int").alias("blocks"))
    dealt = terms.join(blocks, "repo").select("repo", F.pmod(F.xxhash64("path"), F.col("blocks")).cast("int").alias("block"), "path", "v")
    sent = known.join(blocks, "repo").select("repo", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "n", "words")

    def weigh(group: pa.Table, repo: pa.Table) -> pa.Table:
        def entries(column: pa.ChunkedArray) -> tuple:
            lists = column.combine_chunks()
            lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
            flat = lists.flatten()
            return flat.field(0), flat.field(1).to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())

        word, tf, lengths = entries(group["v"])
        term, df, _ = entries(repo["words"])
        at = pc.index_in(word, value_set=term)
        held = at.is_valid().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lengths)), lengths)[held]
        w = (1 + np.log(tf[held])) * (1 + np.log(repo["n"][0].as_py() / df[at.drop_null().to_numpy()]))
        w /= np.sqrt(np.bincount(row, w * w, len(lengths)))[row]
        left = np.bincount(row, minlength=len(lengths))
        v = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]), type=pa.int32()), pa.StructArray.from_arrays([word.filter(pa.array(held)), pa.array(w)], ["term", "weight"]))
        return pa.table({"repo": group["repo"], "path": group["path"], "v": v}).filter(pa.array(left > 0))

    weighed = dealt.groupBy("repo", "block").cogroup(sent.groupBy("repo", "block")).applyInArrow(weigh, "repo string, path string, v array<struct<term string, weight double>>")
    keyed = weighed.withColumn("k", _weights_key())
    vectors = durable(keyed.withColumn("same", F.min("path").over(Window.partitionBy("repo", "k"))).select("repo", "path", "same", "v"))
    release(terms, known)
    return vectors, counts


def _weights_key() -> Column:
    """A hash that files of the same weights, rounded to 4 digits, share."""
    return F.xxhash64(F.array_sort(F.transform("v", lambda e: F.struct((-F.floor(e["weight"] * 10000 + 0.5)).alias("far"), e["term"].alias("term")))))


def _vectors(weights: DataFrame) -> DataFrame:
    """(repo, path, v, k): terms with their weights as an array, and a hash that files of the same weights, rounded to 4 digits, share."""
    rows = weights.groupBy("repo", "path").agg(F.collect_list(F.struct("term", "weight")).alias("v"))
    return rows.withColumn("k", _weights_key())


def _first(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("repo", "k").agg(F.min("path").alias("same"))


def same_terms(weights: DataFrame) -> DataFrame:
    """(repo, path, same): ``same`` is the smallest path of the repository with the same weights, rounded to 4 digits."""
    keyed = _vectors(weights).select("repo", "path", "k")
    return keyed.join(_first(keyed), ["repo", "k"]).select("repo", "path", "same")


def _meetings(kept: DataFrame, blocks: DataFrame) -> DataFrame:
    """(repo, i, j, block, path, terms, values): each file once for every pair of blocks of its repository that its own is one of."""
    own = F.pmod(F.xxhash64("path"), F.col("blocks")).cast("int")
    turns = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j"), own.alias("block")))
    terms, values = F.transform("v", lambda e: F.xxhash64(e["term"])).alias("terms"), F.transform("v", lambda e: e["weight"]).alias("values")
    return kept.join(blocks, "repo").select("repo", "path", terms, values, F.explode(turns).alias("t")).select("repo", "t.*", "path", "terms", "values")


def _reader():
    """A function that reads two blocks that meet; made here so that it is pickled by value."""

    def read(group: pa.Table) -> tuple:
        group = group.sort_by("path").combine_chunks()
        lists = group["terms"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        weights = group["values"].combine_chunks()
        weights = (pa.concat_arrays(weights.chunks) if isinstance(weights, pa.ChunkedArray) else weights).flatten().to_numpy()
        block, bounds = group["block"].to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        row = np.repeat(np.arange(len(block)), np.diff(bounds))
        known, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        left, right = block == i, block == j
        # only terms on both sides count
        both = np.zeros((2, len(known)), dtype=bool)
        both[0, place[left[row]]] = True
        both[1, place[right[row]]] = True
        column = np.where(both.all(axis=0), np.cumsum(both.all(axis=0)) - 1, -1)[place]
        inside = column >= 0
        held = np.zeros((len(block), int(both.all(axis=0).sum())), dtype=np.float32)
        held[row[inside], column[inside]] = weights[inside]
        xs, ys = np.flatnonzero(left), np.flatnonzero(right)
        return group, i == j, xs, ys, held, place, weights, bounds, len(known)

    return read


def similar_pairs(weights: DataFrame, least: float, block_files: int = BLOCK_FILES) -> DataFrame:
    """(repo, a, b, cosine), a < b: pairs of files whose cosine is at least ``least``, between files that stand for all of the same terms.

    The vocabulary of a repository is limited, so that most of its files share
    some term: pairs that do are nearly all pairs. The files of a repository are
    dealt to blocks, every block meets every block, and their cosines are one
    product of matrices. Single precision tells which can reach ``least``; these
    are summed again in double precision.
    """
    vectors = durable(_vectors(weights))
    kept = vectors.join(_first(vectors).withColumnRenamed("same", "path"), ["repo", "k", "path"], "left_semi")
    met = _meetings(kept, vectors.groupBy("repo").agg(F.ceil(F.count(F.lit(1)) / block_files).cast("int").alias("blocks")))
    read = _reader()

    def compare(group: pa.Table) -> pa.Table:
        group, within, xs, ys, held, place, weights, bounds, known = read(group)
        others = held if within else held[ys]
        one = np.zeros(known)  # the weights of one file by term
        first, second, cosines = [], [], []
        for start in range(0, len(xs), 256):
            near = held[xs[start : start + 256]] @ others.T >= least - 1e-4
            for x, hits in zip(xs[start : start + 256], near):
                ends = ys[hits]
                # a pair within a block is met from both sides
                ends = ends[ends > x] if within else ends
                if not len(ends):
                    continue
                mine = slice(bounds[x], bounds[x + 1])
                one[place[mine]] = weights[mine]
                size = bounds[ends + 1] - bounds[ends]
                at = np.arange(size.sum()) + np.repeat(bounds[ends] - np.cumsum(size) + size, size)
                cosine = np.add.reduceat(one[place[at]] * weights[at], np.cumsum(size) - size)
                one[place[mine]] = 0
                ends, cosine = ends[cosine >= least], cosine[cosine >= least]
                first.append(np.minimum(x, ends))
                second.append(np.maximum(x, ends))
                cosines.append(cosine)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
        a, b = (group["path"].take(pa.array(join(p, np.int64))) for p in (first, second))
        return pa.table({"repo": group["repo"].take(pa.array(np.zeros(len(a), dtype=np.int64))), "a": a, "b": b, "cosine": join(cosines, np.float64)})

    return met.groupBy("repo", "i", "j").applyInArrow(compare, "repo string, a string, b string, cosine double")


def similar_links(vectors: DataFrame, counts: DataFrame, limits: list[float], block_files: int = BLOCK_FILES) -> DataFrame:
    """(repo, a, b, cosine): files joined so that each of ``limits`` has the connected parts that all similar pairs have; ``cosine`` is the highest limit that a link reaches.

    Takes ``file_vectors`` with their counts. Pairs are the square of a part, links
    are as many as its files: two blocks that meet give the links of a spanning
    forest, the highest limit first, and so do the forests of ``FOREST_BLOCKS`` by
    as many blocks.
    """
    falling = sorted(limits, reverse=True)
    blocks = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    met = _meetings(vectors.filter("path = same"), blocks.select("repo", F.ceil(F.col("files") / block_files).cast("int").alias("blocks")))
    read = _reader()

    def join(group: pa.Table) -> pa.Table:
        i, j, repo = (group[c][0] for c in ("i", "j", "repo"))
        group, within, xs, ys, held, place, weights, bounds, known = read(group)
        near = held[xs] @ (held if within else held[ys]).T
        one = np.zeros(known)  # the weights of one file by term
        part = np.arange(len(group))
        first, second, reached = [], [], []
        for limit in falling:
            likely = near >= limit - 1e-4
            for r in np.flatnonzero((likely & (part[xs][:, None] != part[ys])).any(axis=1)):
                x = xs[r]
                ends = np.flatnonzero(likely[r] & (part[ys] != part[x]))
                close = near[r, ends] < limit + 1e-4
                if close.any():  # summed again in double precision
                    mine = slice(bounds[x], bounds[x + 1])
                    one[place[mine]] = weights[mine]
                    few = ys[ends[close]]
                    size = bounds[few + 1] - bounds[few]
                    at = np.arange(size.sum()) + np.repeat(bounds[few] - np.cumsum(size) + size, size)
                    cosine = np.add.reduceat(one[place[at]] * weights[at], np.cumsum(size) - size)
                    one[place[mine]] = 0
                    fits = ~close
                    fits[close] = cosine >= limit
                    ends = ends[fits]
                others, at = np.unique(part[ys[ends]], return_index=True)
                if not len(others):
                    continue
                part[np.isin(part, others)] = part[x]
                far = ys[ends[at]]
                first.append(np.minimum(x, far))
                second.append(np.maximum(x, far))
                reached.append(np.full(len(far), limit))
        a, b = (group["path"].take(pa.array(np.concatenate(p) if p else np.zeros(0, dtype=np.int64))) for p in (first, second))
        n = len(a)
        return pa.table({"repo": pa.repeat(repo, n), "i": pa.repeat(i, n), "j": pa.repeat(j, n), "a": a, "b": b, "cosine": np.concatenate(reached) if reached else np.zeros(0)})

    def thin(group: pa.Table) -> pa.Table:
        group = group.sort_by([("cosine", "descending"), ("a", "ascending"), ("b", "ascending")]).combine_chunks()
        ends = pa.chunked_array([*group["a"].chunks, *group["b"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        above = list(range(int(ends.max()) + 1))

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        kept = []
        for k, (x, y) in enumerate(zip(ends[: len(group)].tolist(), ends[len(group) :].tolist())):
            x, y = top(x), top(y)
            if x != y:
                above[y] = x
                kept.append(k)
        return group.select(["repo", "a", "b", "cosine"]).take(pa.array(kept, type=pa.int64()))

    joined = met.groupBy("repo", "i", "j").applyInArrow(join, "repo string, i int, j int, a string, b string, cosine double")
    wide = [F.floor(F.col(c) / FOREST_BLOCKS).cast("int").alias(c) for c in ("i", "j")]
    return joined.select("repo", *wide, "a", "b", "cosine").groupBy("repo", "i", "j").applyInArrow(thin, "repo string, a string, b string, cosine double")


def similar_files(weights: DataFrame, queries: DataFrame, top: int = 5) -> DataFrame:
    """(repo, query, path, cosine, rank): the ``top`` files most similar to each query vector (repo, query, term, weight).

    Cosines are rounded to 3 digits before the ranking; ties go to the smaller
    path. A file named as its own query is left out.
    """
    score = (
        queries.withColumnRenamed("weight", "q")
        .join(weights, ["repo", "term"])
        .filter("path <> query")
        .groupBy("repo", "query", "path")
        .agg(F.sum(F.col("q") * F.col("weight")).alias("s"))
        .select("repo", "query", "path", (F.floor(F.col("s") * 1000 + 0.5) / 1000).alias("cosine"))
        .filter("cosine > 0")
    )
    order = Window.partitionBy("repo", "query").orderBy(F.desc("cosine"), "path")
    return score.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def query_vectors(terms: DataFrame) -> DataFrame:
    """(repo, query, term, weight) from counted terms (repo, query, term, tf): 1 + ln tf, scaled to length one."""
    raw = terms.withColumn("w", 1 + F.log("tf"))
    norm = raw.groupBy("repo", "query").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, ["repo", "query"]).select("repo", "query", "term", (F.col("w") / F.col("norm")).alias("weight"))


def components(pairs: DataFrame) -> DataFrame:
    """(repo, path, component): connected parts of pairs (repo, a, b), named by their smallest path.

    Labels are spread and every label then jumps to its own label's label, so
    that a chain of n files takes about log n rounds.
    """
    # one pass: the pairs may be dear to make
    ends = F.array(F.struct(F.col("a").alias("path"), F.col("b").alias("other")), F.struct(F.col("b").alias("path"), F.col("a").alias("other")))
    both = durable(pairs.select("repo", F.explode(ends).alias("e")).select("repo", "e.*").distinct())
    labels = durable(both.groupBy("repo", "path").agg(F.min(F.least("path", "other")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("path", "other"), ["repo", "other"]).select("repo", "path", "component")
        spread = labels.unionByName(near).groupBy("repo", "path").agg(F.min("component").alias("component"))
        jump = spread.select("repo", F.col("path").alias("component"), F.col("component").alias("far"))
        after = durable(spread.join(jump, ["repo", "component"], "left").select("repo", "path", F.coalesce("far", "component").alias("component")))
        rest = after.join(labels.withColumnRenamed("component", "old"), ["repo", "path"]).filter("component <> old").isEmpty()
        release(labels)
        labels = after
        if rest:
            release(both)
            return labels


def clusters_at(pairs: DataFrame, same: DataFrame, least: float) -> DataFrame:
    """(repo, path, component): files in connected parts at a cosine limit, files of the same terms in one part; parts of one file are left out.

    Takes all similar pairs or the links that stand for them.
    """
    copies = same.filter("path <> same").select("repo", F.col("path").alias("a"), F.col("same").alias("b"))
    return components(pairs.filter(F.col("cosine") >= least).select("repo", "a", "b").unionByName(copies))


def _parts_at(pairs: DataFrame, limits: list[float]) -> DataFrame:
    """(repo, threshold, path, component): the connected parts of (repo, a, b, cosine) at each limit, named by their smallest path; a repository is one task."""
    falling = sorted(limits, reverse=True)

    def grow(group: pa.Table) -> pa.Table:
        group = group.sort_by([("cosine", "descending")]).combine_chunks()
        coded = pa.chunked_array([*group["a"].chunks, *group["b"].chunks]).combine_chunks().dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary)
        paths, rank = coded.dictionary.take(order), np.argsort(order.to_numpy())
        ends, cosine = rank[coded.indices.to_numpy()], group["cosine"].to_numpy()
        above, inside, start = list(range(len(paths))), np.zeros(len(paths), dtype=bool), 0

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        at, found, parts = [], [], []
        for limit in falling:
            end = int((cosine >= limit).sum())
            xs, ys = ends[start:end], ends[len(group) + start : len(group) + end]
            for x, y in zip(xs.tolist(), ys.tolist()):
                x, y = top(x), top(y)
                above[max(x, y)] = min(x, y)
            inside[xs] = inside[ys] = True
            start = end
            held = np.flatnonzero(inside)
            at.append(np.full(len(held), limit))
            found.append(held)
            parts.append(np.array([top(x) for x in held.tolist()], dtype=np.int64))
        path, component = (paths.take(pa.array(np.concatenate(p))) for p in (found, parts))
        return pa.table({"repo": pa.repeat(group["repo"][0], len(path)), "threshold": np.concatenate(at), "path": path, "component": component})

    return pairs.groupBy("repo").applyInArrow(grow, "repo string, threshold double, path string, component string")


def adaptive_clusters(pairs: DataFrame, same: DataFrame, files: DataFrame, least_files: int = 20) -> DataFrame:
    """(repo, threshold, path, component) at the cosine limit that suits each repository.

    The limit starts at .45 and rises by .05, to .70 at most, while the largest
    part holds more than 60 % of the files; it then falls, to .30 at least, while
    less than 10 % of the files are in a part of two or more. Repositories of
    fewer than ``least_files`` files have no clusters. Takes all similar pairs or
    the links that stand for them at ``LIMITS``.
    """
    grid = LIMITS
    copies = same.filter("path <> same").select("repo", F.col("path").alias("a"), F.col("same").alias("b"), F.lit(1.0).alias("cosine"))
    each = pairs.select("repo", "a", "b", "cosine").unionByName(copies)
    if (each.groupBy("repo").count().agg(F.max("count")).first()[0] or 0) <= TASK_LINKS:
        whole = durable(_parts_at(each, grid))
    else:
        # one search for the parts at all limits: a repository at a limit is a graph of its own
        at = F.explode(F.filter(F.array(*map(F.lit, grid)), lambda t: t <= F.col("cosine")))
        graphs = each.select("repo", "a", "b", at.alias("threshold")).select(F.struct("repo", "threshold").alias("repo"), "a", "b")
        whole = durable(components(graphs).select("repo.repo", "repo.threshold", "path", "component"))
    count = files.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_files)
    size = whole.groupBy("repo", "threshold", "component").agg(F.count(F.lit(1)).alias("size")).groupBy("repo", "threshold").agg(F.max("size").alias("largest"), F.sum("size").alias("clustered"))
    steps = count.select("repo", "n", F.explode(F.array(*map(F.lit, grid))).alias("threshold")).join(size, ["repo", "threshold"], "left").na.fill(0, ["largest", "clustered"])
    table = steps.groupBy("repo").agg(F.map_from_entries(F.collect_list(F.struct("threshold", F.struct((F.col("largest") > 0.6 * F.col("n")).alias("huge"), (F.col("clustered") < 0.1 * F.col("n")).alias("few"))))).alias("m"))
    m = F.col("m")
    up = F.aggregate(F.array(*[F.lit(x / 100) for x in range(45, 70, 5)]), F.lit(0.45), lambda t, x: F.when((t == x) & m[x]["huge"], F.floor(x * 100 + 5.5) / 100).otherwise(t))
    down = F.aggregate(F.array(*[F.lit(x / 100) for x in range(70, 30, -5)]), up, lambda t, x: F.when((t == x) & m[x]["few"], F.floor(x * 100 - 4.5) / 100).otherwise(t))
    return whole.join(table.select("repo", down.alias("threshold")), ["repo", "threshold"]).select("repo", "threshold", "path", "component")


def _weights_of(clusters: DataFrame, weights: DataFrame) -> DataFrame:
    """(repo, component, term, weight) of the members; the arrays of ``file_vectors`` come to their part before they are taken apart."""
    held = clusters.join(weights, ["repo", "path"])
    if "v" not in weights.columns:
        return held
    return held.select("repo", "component", "v").repartition("repo", "component").select("repo", "component", F.inline("v"))


def cluster_terms(clusters: DataFrame, weights: DataFrame, top: int = 5) -> DataFrame:
    """(repo, component, files, terms): the terms of highest summed weight of each part, ties by term; takes weights or ``file_vectors``."""
    summed = _weights_of(clusters, weights).groupBy("repo", "component", "term").agg(F.sum("weight").alias("w"))
    order = Window.partitionBy("repo", "component").orderBy((-F.floor(F.col("w") * 10000 + 0.5)), "term")
    best = summed.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).groupBy("repo", "component").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("terms"))
    return clusters.groupBy("repo", "component").agg(F.count(F.lit(1)).alias("files")).join(best, ["repo", "component"])


def cohesion(clusters: DataFrame, weights: DataFrame) -> DataFrame:
    """(repo, component, files, cohesion): the mean cosine of all pairs of a part, to 3 digits.

    It needs no pairs: the squared length of the summed vector is the sum over all
    ordered pairs and over the n files with themselves. Takes weights or ``file_vectors``.
    """
    v = _weights_of(clusters, weights).groupBy("repo", "component", "term").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("weight")).alias("own"))
    whole = v.groupBy("repo", "component").agg((F.sum(F.col("w") * F.col("w")) - F.sum("own")).alias("s"))
    sizes = clusters.groupBy("repo", "component").agg(F.count(F.lit(1)).alias("files"))
    mean = F.col("s") / (F.col("files") * (F.col("files") - 1))
    return sizes.filter("files > 1").join(whole, ["repo", "component"]).select("repo", "component", "files", (F.floor(mean * 1000 + 0.5) / 1000).alias("cohesion"))
