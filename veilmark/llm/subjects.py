"""Problem 10: subject areas of each document.

Method: label propagation over a document-similarity graph. Documents are similar through the terms of their sentences
that they share; the graph is kept factored as links document - term - document, so its size is that of the texts and not
of the pairs, and a term's links are verified: labels pass through it only once enough labelled documents hold it and one
subject holds it beyond its share. Seeds are hand labels that name a subject; they are trusted where the graph does not
contradict them, and trusted ones are clamped in all rounds and in the result. A round joins the links with the terms'
subjects to label the documents, keeps each document's several subjects, and joins the links with the documents' labels to
measure the terms again. At the end a document's propagated subjects are held against its sentences: it deals with those
of its subjects that a quarter of its sentences deal with.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.quality import FUNCTION_WORDS
from veilmark.llm.textform import caseless
from veilmark.session import bounded_broadcast, checkpointed, table

#: A term stands in at least this share of the documents (and twice) and at most the other. With d distinct terms in a
#: mean document at most d / LEAST_SHARE terms pass, whatever the corpus size: that bounds what is broadcast.
LEAST_SHARE, MOST_SHARE = 2e-4, 0.5
#: More terms than this are an error: LEAST_SHARE is to be raised then, nothing is cut.
MOST_TERMS = 2_000_000
ROUNDS = 2
#: Verified: labelled documents that hold the term, and its likelihood of one subject among all.
LEAST_SUPPORT, VERIFIED, DECISIVE = 3, 0.3, 0.6
#: Subjects a document keeps in a round; sentences that make a subject.
KEPT_SHARE, SENTENCE_SHARE = 0.2, 0.25

_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»)]*\s+|\n\s*\n|\n(?!\s*[a-zß-öø-ÿα-ωа-я])")  # a line that goes on in small letters is wrapped
_LINE = re.compile(r"\n+")
_WORD = re.compile(r"[^\W\d_]{2,}(?:-[^\W\d_]+)*")
_SPACELESS = re.compile("[\u0900-\u1fff\u2e80-\uffff]")
#: Words of at least so many make a line in an alphabet a sentence only with a function word among them; signs and digits
#: a word that a sentence has at most.
LISTED_WORDS, MOST_SIGNS = 3, 1.0
_FUNCTION = frozenset(caseless(w) for words in FUNCTION_WORDS.values() for w in words.split())


def sentences(text: str) -> list[str]:
    """Sentences, and lines that are none, without blank ones. A text without full stops is taken by its lines."""
    split = _SENTENCE if any(c in text for c in ".!?…") else _LINE
    return [s for s in split.split(text) if s.strip()]


_INK = bytes(c if chr(c).isalpha() and c < 128 or c == 45 else 32 for c in range(256))


def _words(plain: str) -> list[str]:
    """Words of two letters and more, with the hyphens inside them."""
    if not plain.isascii():
        return _WORD.findall(plain)
    found = [w for w in plain.encode().translate(_INK).decode().split() if len(w) > 1]
    return _WORD.findall(plain) if "-" in plain and any(w[0] == "-" or w[-1] == "-" or "--" in w or w[1] == "-" for w in found) else found


def sentence_terms(plain: str) -> list[str]:
    """The distinct words of a sentence without case, in order; none for what is no sentence: code and tables (more signs
    than words) and lists of words (no function word of any language among several)."""
    found = _words(plain)
    signs = len(plain) - plain.count(" ") - sum(map(len, found))
    if (signs > MOST_SIGNS * len(found) or len(found) >= LISTED_WORDS and _FUNCTION.isdisjoint(found)) and (plain.isascii() or not _SPACELESS.search(plain)):
        return []
    return list(dict.fromkeys(found))


def text_terms(text: str) -> list[list[str]]:
    """The terms of each sentence of a text."""
    caseless_ = str.lower if text.isascii() else caseless
    return [sentence_terms(caseless_(part)) for part in sentences(text)]


def vocabulary(texts: DataFrame) -> dict[str, int]:
    """Terms of the graph with their numbers; bounded by d / LEAST_SHARE (see above). The frequencies are those of the words
    as they are stored, in lower case, by built-in expressions."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{2,}(?:-\p{L}+)*"), F.lit(0)))
    total = texts.count()
    counts = texts.select(F.explode(found).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    kept = counts.where((F.col("n") >= max(2, LEAST_SHARE * total)) & (F.col("n") <= MOST_SHARE * total)).select("term").limit(MOST_TERMS + 1).toArrow().column(0).to_pylist()
    if len(kept) > MOST_TERMS:
        raise ValueError("too many terms for one broadcast: raise LEAST_SHARE")
    return {term: k for k, term in enumerate(sorted(kept))}


def graph(documents: DataFrame) -> DataFrame:
    """(doc_id, sentences, at, terms): links of a document to the graph's terms and the sentences that hold them."""
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL")
    words = documents.sparkSession.sparkContext.broadcast(vocabulary(texts.select("text")))
    schema = pa.schema([("doc_id", pa.int64()), ("sentences", pa.int32()), ("at", pa.list_(pa.int32())), ("terms", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = words.value.get
        for batch in batches:
            n, at, terms = [], [], []
            for text in batch.column(1).to_pylist():
                parts = [[t for w in part if (t := get(w)) is not None] for part in text_terms(text)]
                n.append(len(parts))
                at.append([k for k, part in enumerate(parts) for _ in part])
                terms.append([t for part in parts for t in part])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip((n, at, terms), list(schema)[1:]))], schema=schema)

    nodes = texts.select("doc_id", "text").mapInArrow(run, "doc_id bigint, sentences int, at array<int>, terms array<int>")
    # placed by document once, before the rounds join on it
    return checkpointed(nodes.repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id"))


def named_seeds(labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subject, weight): labels that name a subject area, however written; a document's labels weigh 1 together."""
    named = areas.where("subject IS NOT NULL").select("subject", F.lower(F.trim("subject")).alias("name")).distinct()
    seeds = labels.where("doc_id IS NOT NULL").select("doc_id", F.lower(F.trim("subject")).alias("name")).join(F.broadcast(named), "name").select("doc_id", "subject").distinct()
    share = seeds.groupBy("doc_id").agg((F.lit(1.0) / F.count("*")).alias("weight"))
    return seeds.join(share, "doc_id")


def term_subjects(nodes: DataFrame, labelled: DataFrame) -> DataFrame:
    """(term, subject, likelihood) of verified terms, from the documents' labels (doc_id, subject, weight).

    nodes: doc_id, terms. The join moves a document's terms as one array; they are exploded behind it.
    """
    own = labelled.groupBy("doc_id").agg(F.collect_list(F.struct("subject", "weight")).alias("own"))  # one entry a subject
    held = nodes.join(own, "doc_id").select("terms", F.inline("own")).select("subject", "weight", F.explode("terms").alias("term")).groupBy("term", "subject").agg(F.sum("weight").alias("w"))
    size = labelled.groupBy("subject").agg(F.sum("weight").alias("size"))  # one row a subject
    rate = held.join(F.broadcast(size), "subject").select("term", "subject", "w", (F.col("w") / F.col("size")).alias("rate"))
    by_term = rate.groupBy("term").agg(F.sum("w").alias("support"), F.sum("rate").alias("rates"), F.max("rate").alias("top"), F.collect_list(F.struct("subject", "rate")).alias("own"))
    verified = by_term.where((F.col("support") >= LEAST_SUPPORT) & (F.col("top") >= VERIFIED * F.col("rates")))
    return verified.select("term", "rates", F.inline("own")).select("term", "subject", (F.col("rate") / F.col("rates")).alias("likelihood")).where("likelihood >= 0.02")


def _document_labels(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, subject, weight): subjects of the documents from their terms' subjects, those of at least KEPT_SHARE."""
    links = nodes.select("doc_id", F.explode("terms").alias("term"))
    by_subject = links.join(bounded_broadcast(terms), "term").groupBy("doc_id", "subject").agg(F.sum("likelihood").alias("w"))
    totals = by_subject.groupBy("doc_id").agg(F.sum("w").alias("all"), F.collect_list(F.struct("subject", "w")).alias("own"))  # one entry a subject
    return totals.where(f"all >= {LEAST_SUPPORT}").select("doc_id", F.expr(f"inline(filter(transform(own, x -> struct(x.subject AS subject, x.w / all AS weight)), x -> x.weight >= {KEPT_SHARE}))"))


def propagated(nodes: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(term, subject, likelihood), (doc_id, subject, weight) and the trusted seeds after the rounds.

    nodes: doc_id, terms. A seed is trusted unless the first labelling gives its document other subjects only; where it
    gives none, there is nothing to contradict it.
    """
    seeds = checkpointed(seeds)
    terms = checkpointed(term_subjects(nodes, seeds))
    trusted = None
    for _ in range(rounds):
        found = checkpointed(_document_labels(nodes, terms))
        if trusted is None:
            wrong = seeds.join(found.select("doc_id").distinct(), "doc_id", "left_semi").join(found.select("doc_id", "subject"), ["doc_id", "subject"], "left_anti")
            trusted = checkpointed(seeds.join(wrong.select("doc_id", "subject"), ["doc_id", "subject"], "left_anti"))
        labels = found.join(trusted.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(trusted.select("doc_id", "subject", "weight"))
        terms = checkpointed(term_subjects(nodes, labels))
    return terms, found.select("doc_id", "subject", "weight"), trusted


def subjects_of(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subject, share, seed): the propagated subjects of a document with the share of its sentences that deal with
    each, and whether the pair is a trusted seed (share 0 where only the seed says so).

    documents: doc_id, text; labels: doc_id, subject; areas: subject. Null, empty and blank texts deal with nothing,
    whatever their labels say; without usable labels there is no result. A sentence deals with the subject that most
    of its decisive terms name (those of the greatest likelihood, on a tie).
    """
    nodes = graph(documents)
    terms, found, trusted = propagated(nodes.select("doc_id", F.array_distinct("terms").alias("terms")), named_seeds(labels, areas).join(nodes.where("sentences > 0").select("doc_id").distinct(), "doc_id", "left_semi"))
    best = terms.groupBy("term").agg(F.max_by("subject", F.struct("likelihood", "subject")).alias("subject"), F.max("likelihood").alias("likelihood")).where(f"likelihood >= {DECISIVE}")
    table_ = best.toArrow()  # at most MOST_TERMS rows
    term = table_.column("term").to_numpy()
    subject = table_.column("subject").to_pylist()
    names = sorted(set(subject))
    number = np.full(int(term.max(initial=0)) + 1, -1, np.int32)
    weight = np.zeros(len(number))
    number[term], weight[term] = [names.index(x) for x in subject], table_.column("likelihood").to_numpy()
    known = documents.sparkSession.sparkContext.broadcast((names, number, weight))
    schema = pa.schema([("doc_id", pa.int64()), ("subject", pa.string()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, number, weight = known.value
        k = len(names)
        for batch in batches:
            ids, n = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column(3)
            terms = lists.flatten().to_numpy(zero_copy_only=False)
            at = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
            first = np.concatenate([[0], np.cumsum(n)])
            use = terms < len(number)
            use[use] = number[terms[use]] >= 0
            votes = np.zeros((first[-1], max(k, 1)))
            np.add.at(votes, (first[owner[use]] + at[use], number[terms[use]]), 1 + 1e-3 * weight[terms[use]])
            decided = np.flatnonzero(votes.max(1) > 0) if len(votes) else np.zeros(0, int)
            counts = np.zeros((len(ids), max(k, 1)))
            np.add.at(counts, (np.searchsorted(first, decided, "right") - 1, votes[decided].argmax(1) if len(decided) else decided), 1)
            row, subject = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row], pa.int64()), pa.array([names[s] for s in subject], pa.string()), pa.array(counts[row, subject] / n[row], pa.float64())], schema=schema)

    measured = nodes.mapInArrow(run, "doc_id bigint, subject string, share double")
    both = found.select("doc_id", "subject").distinct().join(measured, ["doc_id", "subject"])
    seed = trusted.select("doc_id", "subject", F.lit(True).alias("seed"))
    return both.join(seed, ["doc_id", "subject"], "full_outer").select("doc_id", "subject", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("seed", F.lit(False)).alias("seed"))


def subject_areas(spark: SparkSession, folder: str) -> DataFrame:
    """p10_found: (doc_id, subject) for each propagated subject of at least a quarter of the document's sentences, and for
    each trusted seed."""
    found = subjects_of(table(spark, folder, "documents"), table(spark, folder, "subject_labels"), table(spark, folder, "subject_areas"))
    return found.where((F.col("share") >= SENTENCE_SHARE) | F.col("seed")).select("doc_id", "subject").distinct()
