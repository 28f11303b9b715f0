"""Retrievers over a frame of questions: all questions are answered in one plan.

Units are (chunk_id, passage_id, text); questions are (query_id, query_text). Hits are
(query_id, chunk_id, passage_id, score, rank) and more columns by retriever.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions import vectors
from . import index
from .ranking import ranked, rrf, top_hits


def few(questions: DataFrame, most: int = 5_000) -> bool:
    """Whether there are few enough questions to send what is made of them alone (their terms, with a row for each) to all tasks."""
    return questions.limit(most + 1).count() <= most


def sender(questions: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Marks frames with at most a few dozen rows for each question for broadcast, if there are few questions; else leaves
    them, and joins shuffle. The check counts questions, never what is made of them."""
    return F.broadcast if few(questions) else (lambda df: df)


def bm25(questions: DataFrame, units: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, stop: list[str] | None = None) -> DataFrame:
    """Lucene's BM25: idf = ln(1 + (N - df + 0.5) / (df + 0.5)), tf / (tf + k1 (1 - b + b dl / avgdl)).

    A query term counts as often as it occurs. Units without tokens count for N and the mean length. Units are tokenised
    once: one shuffle by unit has the postings of query terms and, under the empty term, a row for each unit's length.
    """
    sent = sender(questions)
    tokenised = index.lengths(units, stop)
    asked = questions.select("query_id", F.explode(tx.index_tokens(F.col("query_text"), stop)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    terms = asked.select("term").distinct().unionByName(questions.sparkSession.createDataFrame([("",)], "term string"))
    rows = tokenised.select("chunk_id", "passage_id", F.size("tokens").alias("dl"), F.explode(F.array_append("tokens", F.lit(""))).alias("term")).join(sent(terms), "term")
    found = rows.repartition("chunk_id").groupBy("chunk_id", "passage_id", "dl", "term").agg(F.count("*").alias("tf"))  # scores are then summed in place
    stats = found.where("term = ''").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = found.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    weighted = df.crossJoin(F.broadcast(stats)).select("term", "avgdl", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # stats is one row
    tf = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    parts = found.where("term <> ''").join(sent(weighted), "term").select("chunk_id", "passage_id", "term", (F.col("idf") * tf).alias("part"))
    if few(questions):
        return top_hits(summed(parts, asked, k), k)
    scored = parts.join(asked, "term").groupBy("query_id", "chunk_id", "passage_id").agg(F.round(F.sum(F.col("qf") * F.col("part")), 6).alias("score"))
    return top_hits(scored.where("score > 0"), k)


def index_terms(questions: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """(query_id, term, qf): the index terms of the questions with their counts."""
    return questions.select("query_id", F.explode(tx.index_tokens(F.col("query_text"), stop)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))


def weighed(asked: DataFrame, lexical: index.Lexical, is_few: bool, k: int, k1: float, b: float) -> DataFrame:
    """The best hits of `asked` (query_id, term, qf) by BM25 over a stored index."""
    sent = F.broadcast if is_few else (lambda df: df)
    terms = asked.select("term").distinct()
    weighted = lexical.df.join(sent(terms), "term").crossJoin(F.broadcast(lexical.stats)).select("term", "avgdl", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # stats is one row
    tf = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    parts = lexical.found(terms).join(sent(weighted), "term").select("chunk_id", "passage_id", "term", (F.col("idf") * tf).alias("part"))
    if is_few:
        return top_hits(summed(parts, asked, k), k)
    scored = parts.join(asked, "term").groupBy("query_id", "chunk_id", "passage_id").agg(F.round(F.sum(F.col("qf") * F.col("part")), 6).alias("score"))
    return top_hits(scored.where("score > 0"), k)


def bm25_indexed(questions: DataFrame, lexical: index.Lexical, k: int = 10, k1: float = 1.2, b: float = 0.75, stop: list[str] | None = None) -> DataFrame:
    """`bm25` over a stored index: the postings of the questions' terms are read, no text."""
    return weighed(index_terms(questions, stop), lexical, few(questions), k, k1, b)


def bm25_stemmed(questions: DataFrame, lexical: index.Lexical, k: int = 10, k1: float = 1.2, b: float = 0.75, stop: list[str] | None = None) -> DataFrame:
    """`bm25_indexed` over an index by stem (`index.stemmed`); the questions' terms are stemmed as the index's were."""
    asked = index_terms(questions, stop)
    by_stem = asked.join(index.stem_table(asked), "term").groupBy("query_id", F.col("stem").alias("term")).agg(F.sum("qf").alias("qf"))
    return weighed(by_stem, lexical, few(questions), k, k1, b)


def term_cosine_indexed(questions: DataFrame, lexical: index.Lexical, k: int = 10, stop: list[str] | None = None) -> DataFrame:
    """Cosine of binary term vectors over a stored index, a dense retriever that needs no model: shared distinct terms by
    the root of the product of both numbers of distinct terms."""
    asked = questions.select("query_id", F.array_distinct(tx.index_tokens(F.col("query_text"), stop)).alias("terms"))
    asked = asked.select("query_id", F.size("terms").alias("n_asked"), F.explode("terms").alias("term"))
    sent = sender(questions)
    shared = lexical.found(asked.select("term")).join(sent(asked), "term").groupBy("query_id", "n_asked", "chunk_id", "passage_id").agg(F.count("*").alias("both"), F.max("n_terms").alias("n_terms"))
    return top_hits(shared.select("query_id", "chunk_id", "passage_id", F.round(F.col("both") / F.sqrt((F.col("n_asked") * F.col("n_terms")).cast("double")), 6).alias("score")), k)


def best_cells(score: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of what may be among the k best of a row and is above `floor`; ties with the k-th stay, as they are
    decided later."""
    least = np.partition(score, -k, axis=1)[:, -k][:, None] if score.shape[1] > k else -np.inf
    return np.nonzero((score >= least) & (score > floor))


def best_pairs(score: np.ndarray, best: np.ndarray, to_digits: Callable[[np.ndarray, int], np.ndarray] = np.round) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of what may be among the k best of a column of `score` (above 0), given the k best scores before (`best`: column, k),
    and those with it. Ties with the k-th stay, as they are decided later. Only what may come in is rounded and sorted."""
    u, q = np.nonzero(score > np.maximum(best[:, -1], 0.0) - 1e-6)
    s = to_digits(score[u, q], 6)
    u, q, s = u[s > 0], q[s > 0], s[s > 0]
    k = best.shape[1]
    every, column = np.concatenate([best.ravel(), s]), np.concatenate([np.repeat(np.arange(len(best)), k), q])
    order = np.lexsort((-every, column))
    sizes = np.bincount(column, minlength=len(best))
    first = (np.cumsum(sizes) - sizes)[:, None] + np.arange(k)
    best = every[order[first]]
    stay = s >= best[q, -1]
    return u[stay], q[stay], s[stay], best


def summed(parts: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Scores of units (parts: chunk_id, passage_id, term, part) for few questions (asked: query_id, term, qf), whose term counts go to
    all tasks: a posting adds to the questions that have its term, and a task hands on what is among its own k best units of a
    question so far, instead of a row for every pair of question and unit. Terms move as their numbers."""
    counts = asked.toArrow()  # at most a few dozen rows for each of the few questions
    terms = {t: i for i, t in enumerate(dict.fromkeys(counts["term"].to_pylist()))}
    ids = np.array(sorted(set(counts["query_id"].to_pylist())), np.int64)
    at = {q: i for i, q in enumerate(ids.tolist())}
    cells = np.array([[terms[t], at[q], n] for t, q, n in zip(*(counts[c].to_pylist() for c in ("term", "query_id", "qf")), strict=True)], np.int64).reshape(-1, 3)
    cells = cells[np.argsort(cells[:, 0], kind="stable")]  # a term's questions follow each other
    sizes = np.bincount(cells[:, 0], minlength=len(terms))
    starts = np.cumsum(sizes) - sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        best = np.full((len(ids), k), -np.inf)

        def scores(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal best
            chunk, passage, part = (rows[c].to_numpy() for c in ("chunk_id", "passage_id", "part"))
            term = rows["term"].to_numpy()
            opens = np.concatenate([[True], chunk[1:] != chunk[:-1]])
            first, unit = np.flatnonzero(opens), np.cumsum(opens) - 1
            # Units are taken together as far as their matrix and their postings' questions stay within a few million cells.
            cost = np.cumsum(np.add.reduceat(sizes[term], first) + len(ids)) // 2_000_000
            for lo, hi in zip(*(lambda cuts: (cuts[:-1], cuts[1:]))(np.concatenate([[0], np.flatnonzero(np.diff(cost)) + 1, [len(first)]])), strict=True):
                a, b = first[lo], first[hi] if hi < len(first) else len(chunk)
                n = sizes[term[a:b]]
                row = np.repeat(np.arange(a, b), n)
                cell = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + starts[term[row]]
                score = np.bincount((unit[row] - lo) * len(ids) + cells[cell, 1], cells[cell, 2] * part[row], (hi - lo) * len(ids)).reshape(-1, len(ids))
                u, q, s, best = best_pairs(score, best)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(chunk[first[lo + u]]), pa.array(passage[first[lo + u]]), pa.array(s)], names=["query_id", "chunk_id", "passage_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            last = int(np.searchsorted(held["chunk_id"].to_numpy(), held["chunk_id"][-1].as_py()))  # the last unit may go on
            if last:
                yield from scores(held.slice(0, last))
                held = held.slice(last)
        if held is not None:
            yield from scores(held)

    numbers = parts.sparkSession.createDataFrame(list(terms.items()), "term string, nth int")
    rows = parts.join(F.broadcast(numbers), "term").select("chunk_id", "passage_id", F.col("nth").alias("term"), "part")
    return rows.repartition("chunk_id").sortWithinPartitions("chunk_id").mapInArrow(run, "query_id long, chunk_id long, passage_id long, score double")


def flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def scored_block(ids: np.ndarray, matrix: np.ndarray, vectors_of: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    """What may be among the k best of each question (ids, rows of `matrix`) in a batch (chunk_id, passage_id, embedding)."""
    own = flat(vectors_of.column("embedding")).reshape(vectors_of.num_rows, -1)
    for lo in range(0, len(ids), 512):
        score = np.round(matrix[lo : lo + 512] @ own.T, 6)
        q, v = best_cells(score, k)
        yield pa.RecordBatch.from_arrays([pa.array(ids[lo + q]), vectors_of.column("chunk_id").take(pa.array(v)), vectors_of.column("passage_id").take(pa.array(v)), pa.array(score[q, v])], names=["query_id", "chunk_id", "passage_id", "score"])


SCORED = "query_id long, chunk_id long, passage_id long, score double"


def dense(queries: DataFrame, vectors_of: DataFrame, k: int = 10, floor: float | None = None, most: int = 20_000) -> DataFrame:
    """Exact cosine top-k. `queries`: (query_id, query_vec); `vectors_of`: (chunk_id, passage_id, embedding), unit vectors.

    Up to `most` questions go to the vectors as one matrix: a batch of vectors costs a matrix product, and each batch hands on
    its own best k for each question. More questions are dealt to blocks of `most`, each of which meets all parts of the vectors
    (`in_blocks`). Scores are the same products either way.
    """
    queries, vectors_of = queries.select("query_id", "query_vec"), vectors_of.select("chunk_id", "passage_id", "embedding")
    if queries.limit(most + 1).count() > most:
        scored = in_blocks(queries, vectors_of, k, most)
    else:
        asked = queries.toArrow()  # at most `most` rows
        ids = asked["query_id"].to_numpy()
        matrix = flat(asked["query_vec"].combine_chunks()).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))
        shared = queries.sparkSession.sparkContext.broadcast(matrix)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(ids):
                    yield from scored_block(ids, shared.value, batch, k)

        scored = vectors_of.mapInArrow(run, SCORED)
    return top_hits(scored if floor is None else scored.where(F.col("score") >= floor), k)


def in_blocks(queries: DataFrame, vectors_of: DataFrame, k: int, most: int, part: int = 20_000) -> DataFrame:
    """Every question against every vector, in blocks of at most about `most` questions and `part` vectors: what may be among the
    k best of each block. A vector moves once for each block of questions, a question once for each part of the vectors."""
    blocks, parts = max(1, -(-queries.count() // max(1, most))), -(-vectors_of.count() // part)
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(max(parts, 1) - 1))))
    own = vectors_of.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(max(parts, 1))).cast("int"))
    own = own.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))

    def run(questions: pa.Table, found: pa.Table) -> pa.Table:
        if not len(questions) or not len(found):
            return pa.table({"query_id": pa.array([], pa.int64()), "chunk_id": pa.array([], pa.int64()), "passage_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids = questions["query_id"].to_numpy()
        matrix = flat(questions["query_vec"].combine_chunks()).reshape(len(ids), -1)
        return pa.Table.from_batches([b for batch in found.to_batches(4096) for b in scored_block(ids, matrix, batch, k)])

    return asked.groupBy("block", "part").cogroup(own.groupBy("block", "part")).applyInArrow(run, SCORED)


def hybrid(questions: DataFrame, units: DataFrame, queries: DataFrame, vectors_of: DataFrame, k: int = 10) -> DataFrame:
    """Fusion of 3k dense and 3k lexical hits."""
    return rrf({"dense": dense(queries, vectors_of, 3 * k), "bm25": bm25(questions, units, 3 * k)}, k)


def asked_terms(questions: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, term)."""
    return questions.select("query_id", F.explode(tx.search_terms(F.col("query_text"), most)).alias("term"))


def words_of(text: Column) -> Column:
    """Distinct words at which a search term may match as a whole word: maximal runs of letters, digits and _, in lower
    case, and the runs with ' and - in them."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def term_matches(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, passage_id, term): passages in which the term stands as a whole word, in either case.

    Ids and words meet by the term's first word (an equi join). A term is one word unless it holds ' or -, and then is matched;
    for others the text of each candidate is fetched once and looked at.
    """
    terms = asked_terms(questions).withColumn("word", F.regexp_extract("term", r"^[a-z0-9]+", 0))
    at = passages.select("passage_id", F.explode(words_of(F.col("text"))).alias("word"))
    met = at.join(sender(questions)(terms), "word").select("query_id", "passage_id", "term", (F.col("term") == F.col("word")).alias("plain")).distinct()
    whole = F.concat(F.lit(r"(^|[^\p{L}\p{N}_])"), F.col("term"), F.lit(r"([^\p{L}\p{N}_]|$)"))
    others = met.where("not plain").drop("plain").join(passages.select("passage_id", "text"), "passage_id")
    looked = others.where(F.rlike(F.lower("text"), whole)).select("query_id", "passage_id", "term")
    return met.where("plain").drop("plain").unionByName(looked).distinct()


def literal_passages(questions: DataFrame, passages: DataFrame, candidates: int = 50) -> DataFrame:
    """(query_id, passage_id, score, terms, nth): the best passages by the sum of ln(N / df) of the terms in them. The part
    of `literal` that all strategies share."""
    n = passages.agg(F.count("*").alias("n"))
    found = term_matches(questions, passages)
    df = found.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    scored = found.join(df, ["query_id", "term"]).crossJoin(F.broadcast(n))  # one row
    scored = scored.groupBy("query_id", "passage_id").agg(F.round(F.sum(F.ln(F.col("n") / F.col("df"))), 6).alias("score"), F.sort_array(F.collect_set("term")).alias("terms"))
    return ranked(scored, ["query_id"], [F.desc("score"), F.asc("passage_id")], candidates, "nth")


def of_passages(passages: DataFrame, best: DataFrame) -> DataFrame:
    """The passages that are among `best` (passage_id): what is done to texts after this is done to those alone."""
    return passages.join(best.select("passage_id").distinct(), "passage_id", "left_semi")


def literal(questions: DataFrame, passages: DataFrame, chunks_of: Callable[[DataFrame], DataFrame], k: int = 10, candidates: int = 50, best: DataFrame | None = None) -> DataFrame:
    """Literal-term retrieval: of the best `candidates` passages (`best`, if they are known) the chunk that holds most of
    the terms, the earlier one of ties, stands for the passage. Only those passages are cut into chunks."""
    best = literal_passages(questions, passages, candidates) if best is None else best
    chunks_text = chunks_of(of_passages(passages, best))
    held = chunks_text.select("chunk_id", "passage_id", "chunk_index", F.lower("text").alias("low")).join(best, "passage_id")
    held = held.withColumn("chunk_hits", F.size(F.filter("terms", lambda t: F.contains("low", t)))).drop("low")
    one = ranked(held, ["query_id", "passage_id"], [F.desc("chunk_hits"), F.asc("chunk_index")], 1, "pick").drop("pick", "nth")
    return top_hits(one, k)


def gram_sets(rows: DataFrame, key: str, df: DataFrame) -> DataFrame:
    """(key, grams, size): the distinct trigrams of `key`, the rarest first by `df` (gram, df), ties by gram; grams that `df` does not
    have come before all, as the rarest."""
    each = rows.select(key, F.explode(tx.trigrams(F.col(key))).alias("gram")).join(df, "gram", "left").fillna(0, ["df"])
    each = each.repartition(rows.sparkSession.sparkContext.defaultParallelism, key)  # few bytes, of which much is made: not for AQE to put together
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "gram"))), lambda x: x["gram"]).alias("grams"), F.count("*").alias("size"))


def prefixes(sets: DataFrame, key: str, floor: float) -> DataFrame:
    """(key, size, place, gram): the first ``size - ceil(floor * size) + 1`` grams. Of two sets alike by `floor` at least, these have a
    gram in common: otherwise all they share lies in the rest of one, which is too small."""
    length = F.col("size") - F.ceil(F.lit(floor) * F.col("size") - 1e-9) + 1
    return sets.select(key, "size", F.posexplode(F.slice("grams", F.lit(1), length.cast("int"))).alias("place", "gram"))


def name_candidates(terms: DataFrame, kept: DataFrame, floor: float, sent: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs (term, name), sets of the terms, sets of the names): pairs that may be alike by `floor`. If the terms' grams are `sent` to
    all tasks, a name meets them where it is, and no task has all names of a frequent gram.

    A term and a name meet only by a gram in both prefixes, and the sizes and places leave room for enough shared grams: what
    two sets can still share after a first gram at places i and j is the smaller of what is left of both.
    """
    names = kept.select("name").distinct()
    df = names.select(F.explode(tx.trigrams(F.col("name"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    a, b = gram_sets(terms.select("term").distinct(), "term", df), gram_sets(names, "name", df)
    left = prefixes(a, "term", floor).withColumnsRenamed({"size": "na", "place": "pa"})
    right = prefixes(b, "name", floor).withColumnsRenamed({"size": "nb", "place": "pb"})
    met = right.join(sent(left), "gram").where((F.col("na") >= floor * F.col("nb") - 1e-9) & (F.col("nb") >= floor * F.col("na") - 1e-9))
    first = met.groupBy("term", "name", "na", "nb").agg(F.min(F.struct("pa", "pb")).alias("p"))
    room = F.least(F.col("na") - F.col("p.pa"), F.col("nb") - F.col("p.pb"))
    need = F.lit(floor) / (1 + floor) * (F.col("na") + F.col("nb")) - 1e-9
    return first.where(room >= need).select("term", "name"), a, b


def alike_names(terms: DataFrame, kept: DataFrame, floor: float = 0.3, sent: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(term, name, doc_freq, sim): names whose trigrams are like a term's, at least by `floor`. Sets meet by their rarest grams
    (`name_candidates`), and only those pairs are compared."""
    pairs, a, b = name_candidates(terms, kept, floor, sent)
    rows = pairs.join(sent(a.select("term", F.col("grams").alias("ga"))), "term").join(b.select("name", F.col("grams").alias("gb")), "name")
    both = F.size(F.array_intersect("ga", "gb"))
    sim = F.round(both / (F.size("ga") + F.size("gb") - both), 6)
    return rows.withColumn("sim", sim).where(F.col("sim") >= floor).select("term", "name", "sim").join(kept.select("name", "doc_freq"), "name").select("term", "name", "doc_freq", "sim")


def holding_names(terms: DataFrame, kept: DataFrame, sent: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(term, name): names that hold a term of three characters or more. They meet by the term's first three."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - 2, F.lit(1))), lambda i: F.substr(F.col("name"), i, F.lit(3))))
    at = kept.select("name", F.explode(grams).alias("gram"))
    asked = terms.where(F.length("term") >= 3).select("term", F.left("term", F.lit(3)).alias("gram"))
    return at.join(sent(asked), "gram").where(F.contains("name", F.col("term"))).select("term", "name")


def match_entities(terms: DataFrame, kept: DataFrame, per_term: int = 3, floor: float = 0.55, sent: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(query_id, name, doc_freq, term, sim): entities for terms (query_id, term).

    A term that is an entity's name matches it alone; any other matches its `per_term` most similar names by trigrams, if at
    least `floor`.
    """
    exact = terms.join(kept, terms["term"] == kept["name"]).select("query_id", "name", "doc_freq", "term", F.lit(1.0).alias("sim"))
    missed = terms.join(kept.select(F.col("name").alias("term")), "term", "left_anti").select("term").distinct()
    near = alike_names(missed, kept, floor, sent)
    best = ranked(near, ["term"], [F.desc("sim"), F.desc("doc_freq"), F.asc("name")], per_term, "nth").select("term", "name", "doc_freq", "sim")
    return exact.unionByName(terms.join(best, "term").select("query_id", "name", "doc_freq", "term", "sim"))


def graph_scores(questions: DataFrame, edges: DataFrame, kept: DataFrame, n_passages: int, candidates: int = 40, hop_entities: int = 15, damping: float = 0.3) -> DataFrame:
    """(query_id, passage_id, score, path): seeds score ln(N / df) on their passages; the entities that occur most with the
    seeds in the best passages add a damped share on all of theirs. An entity matched twice counts once."""
    sent = sender(questions)
    seeds = match_entities(asked_terms(questions), kept, sent=sent).groupBy("query_id", "name", "doc_freq").agg(F.max("sim").alias("sim"))
    weight = F.ln(F.lit(float(n_passages)) / F.greatest("doc_freq", F.lit(1)))
    lists = edges.select("name", "passage_id")
    first = lists.join(sent(seeds), "name").select("query_id", "passage_id", weight.alias("w"), F.col("name").alias("step"))
    scored = first.groupBy("query_id", "passage_id").agg(F.round(F.sum("w"), 6).alias("score"))
    best = ranked(scored, ["query_id"], [F.desc("score"), F.asc("passage_id")], candidates, "nth").select("query_id", "passage_id")
    size = best.groupBy("query_id").agg(F.count("*").alias("n_best"))
    beside = edges.join(sent(best), "passage_id").join(seeds.select("query_id", "name"), ["query_id", "name"], "left_anti")
    beside = ranked(beside.groupBy("query_id", "name", "doc_freq").agg(F.count("*").alias("co")), ["query_id"], [F.desc("co"), F.asc("name")], hop_entities, "nth")
    hop = lists.join(sent(beside.join(size, "query_id").drop("nth")), "name")
    second = hop.select("query_id", "passage_id", (damping * weight * F.col("co") / F.col("n_best")).alias("w"), F.concat(F.lit("~"), F.col("name")).alias("step"))
    return first.unionByName(second).groupBy("query_id", "passage_id").agg(F.round(F.sum("w"), 6).alias("score"), F.slice(F.sort_array(F.collect_set("step")), 1, 8).alias("path"))


def term_likeness(question: Column, text: Column) -> Column:
    """Cosine of the binary term vectors of two texts, the default of `graph`."""
    return F.round(vectors.term_cosine(F.array_distinct(tx.index_tokens(question)), F.array_distinct(tx.index_tokens(text))), 6)


def graph(
    questions: DataFrame,
    edges: DataFrame,
    kept: DataFrame,
    n_passages: int,
    passages: DataFrame,
    chunks_of: Callable[[DataFrame], DataFrame],
    k: int = 10,
    candidates: int = 40,
    likeness: Callable[[Column, Column], Column] = term_likeness,
    best: DataFrame | None = None,
) -> DataFrame:
    """Graph retrieval: of the best `candidates` passages (`best`, if they are known) the chunk most alike to the question by
    `likeness` of both texts, the earlier one of ties, stands for the passage. Only those passages are cut into chunks."""
    if best is None:
        best = ranked(graph_scores(questions, edges, kept, n_passages, candidates), ["query_id"], [F.desc("score"), F.asc("passage_id")], candidates, "nth")
    chunks = chunks_of(of_passages(passages, best))
    held = chunks.select("chunk_id", "passage_id", "chunk_index", "text").join(best.drop("nth"), "passage_id").join(sender(questions)(questions.select("query_id", "query_text")), "query_id")
    held = held.withColumn("likeness", likeness(F.col("query_text"), F.col("text"))).drop("query_text", "text")
    return top_hits(ranked(held, ["query_id", "passage_id"], [F.desc("likeness"), F.asc("chunk_index")], 1, "pick").drop("pick"), k)
