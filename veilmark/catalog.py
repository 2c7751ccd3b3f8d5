"""Named queries of the engine over the Parquet tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilmark import oracles
from veilmark.functions import text as T
from veilmark.functions.statistics import exact_percentile, jaccard, sample_sd
from veilmark.operators import artifacts, attacks, audit, bagpairs, bpe, classifier, corpus, gathered, metrics, paillier, privacy, reporting, roles, tokens, unitbags
from veilmark.operators.private_bpe import PrivateTraining, apply_merges, merge_round, rounds_by_mode
from veilmark.plans import build, matrix
from veilmark.plans.experiment import packed_attacks
from veilmark.session import checkpointed, one_copy, table
from veilmark.streaming import events as streams

SEED = 20260726
VOCAB, SHADOW_VOCAB, CANDIDATES = 2000, 800, 64
#: Of attack_results: tokens of target and shadow tokenizers, shadow plans behind the background, tokens that naive Bayes scores.
ATTACKED_VOCAB, AUXILIARY_GROUPS, SCORED_TOKENS = 16_000, 10, 20_000
M = "manifest_id"


# ---- inputs -------------------------------------------------------------------------------------------------------


def records(s: SparkSession, d: str, *columns: str, where: str = "true") -> DataFrame:
    """Distinct records: (idx, columns...), one row of those delivered several times."""
    return one_copy(s, d, "stream_final_c4", "source_record_index", *(columns or ("site_id", "text")), where=where).withColumnRenamed("source_record_index", "idx")


def checked(s: SparkSession, d: str) -> DataFrame:
    return corpus.with_validity(records(s, d))


def accepted(s: SparkSession, d: str) -> DataFrame:
    """Valid records with a site and the hash of their collapsed, case-folded text."""
    return checked(s, d).where("reason IS NULL AND site_id IS NOT NULL").withColumn("norm_hash", F.sha2(T.collapsed(F.col("text")), 256)).drop("reason")


def texts(s: SparkSession, d: str) -> DataFrame:
    return records(s, d).where("site_id IS NOT NULL AND text IS NOT NULL")


def all_roles(s: SparkSession, d: str) -> DataFrame:
    """(manifest_id, role, site_id) of every manifest, distinct."""
    return roles.manifest_roles(table(s, d, "manifests"))


def in_role(s: SparkSession, d: str, role: str) -> DataFrame:
    """(manifest_id, site_id) of a role in every manifest."""
    return all_roles(s, d).where(F.col("role") == role).select(M, "site_id")


def training(s: SparkSession, d: str) -> DataFrame:
    """(manifest_id, shadow_id, site_id) of every manifest."""
    return roles.shadow_training(table(s, d, "manifests"))


def unit_table(s: SparkSession, d: str) -> DataFrame:
    """(site_id, unit, cnt) of the whole corpus."""
    return tokens.unit_counts(texts(s, d), "site_id")


def shared_units(s: SparkSession, d: str) -> DataFrame:
    """unit_table, written once where a query uses it several times: it is far smaller than the texts behind it."""
    return checkpointed(unit_table(s, d))


def bags(s: SparkSession, d: str) -> DataFrame:
    """(site_id, size, bag): the units of each site as one packed row, for queries that sum them up in many groups of sites."""
    return unitbags.site_bags(texts(s, d))


def packed_vocabs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """target_vocab and shadow_vocab from bags."""
    lists = unitbags.top_units(bags(s, d), in_role(s, d, "target_member"), training(s, d), VOCAB, SHADOW_VOCAB)
    return unitbags.target_rows(lists), unitbags.shadow_rows(lists)


def packed_target(s: SparkSession, d: str, packed: DataFrame) -> DataFrame:
    """target_vocab from bags; no bag is sent for the shadows' sake."""
    return unitbags.target_rows(unitbags.top_units(packed, in_role(s, d, "target_member"), training(s, d).where("false"), VOCAB, SHADOW_VOCAB))


def target_vocab(s: SparkSession, d: str, units: DataFrame | None = None) -> DataFrame:
    """(manifest_id, token, id): the most frequent units of each manifest's member sites."""
    return tokens.top_units_as_vocab((units or unit_table(s, d)).join(in_role(s, d, "target_member"), "site_id"), VOCAB, M)


def shadow_vocab(s: SparkSession, d: str, units: DataFrame | None = None) -> DataFrame:
    """(manifest_id, shadow_id, token, id): the most frequent units of each shadow's training sites."""
    return tokens.top_units_as_vocab((units or unit_table(s, d)).join(training(s, d), "site_id"), SHADOW_VOCAB, M, "shadow_id")


def site_tokens(s: SparkSession, d: str, units: DataFrame | None = None, vocab: DataFrame | None = None) -> DataFrame:
    """(site_id, token, cnt) of every site by substrings, over the tokens of all target vocabularies; each unit is searched
    once for all manifests."""
    counts = units or shared_units(s, d)
    return tokens.token_counts(counts, tokens.substring_tokens(counts, vocab or target_vocab(s, d, counts)), "site_id")


class Experiment(NamedTuple):
    """What the substring attacks share in every manifest."""

    vocab: DataFrame  # (manifest_id, token, id)
    counts: DataFrame  # (manifest_id, site_id, token, cnt) of pool and involved sites
    background: DataFrame  # (manifest_id, token, cnt)
    present: DataFrame  # (manifest_id, site_id) of the pool, with texts


def experiment(s: SparkSession, d: str, top_k: int | None = None) -> Experiment:
    """With top_k only the tokens of the highest ids are counted, as only they are scored."""
    units = shared_units(s, d)
    vocab = checkpointed(target_vocab(s, d, units))
    used = attacks.most_ids(vocab, top_k, M) if top_k else vocab.select(M, "token")
    sites = checkpointed(in_role(s, d, "target_pool").union(involved(s, d)).distinct())
    counts = site_tokens(s, d, units, used).join(sites, "site_id").join(used, [M, "token"], "left_semi")
    counts = checkpointed(counts.select(M, "site_id", "token", "cnt"))
    present = in_role(s, d, "target_pool").join(units.select("site_id").distinct(), "site_id", "left_semi")
    return Experiment(vocab, counts, tokens.background_counts(counts, involved(s, d), M), present)


def involved(s: SparkSession, d: str) -> DataFrame:
    """(manifest_id, site_id): sites of the first two shadow plans."""
    return training(s, d).where("shadow_id < 2").select(M, "site_id").distinct()


def scores(s: SparkSession, d: str) -> DataFrame:
    return metrics.clean_scores(table(s, d, "attack_details"), "run_id")


def run_metrics(s: SparkSession, d: str) -> DataFrame:
    """(run_id, manifest, attack, metrics...)."""
    m = metrics.scalar_metrics(scores(s, d), "run_id")
    return m.withColumn("manifest", F.regexp_extract("run_id", r"^run_(\d+)_", 1).cast("bigint")).withColumn("attack", F.regexp_extract("run_id", r"^run_\d+_(.*)$", 1))


def words(s: SparkSession, d: str) -> DataFrame:
    return tokens.words_of(unit_table(s, d), "site_id")


def site_pairs(s: SparkSession, d: str) -> DataFrame:
    """(site_id, left, right, cnt) of every site, counted once for all manifests."""
    return checkpointed(tokens.symbol_pairs(words(s, d), "site_id"))


def public_pairs(s: SparkSession, d: str, pairs: DataFrame) -> DataFrame:
    return pairs.join(in_role(s, d, "public_candidate"), "site_id")


def no_vocab(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("th",), ("in",)], "token string")


def candidates(s: SparkSession, d: str, pairs: DataFrame, size: int = CANDIDATES) -> DataFrame:
    return tokens.top_pairs(public_pairs(s, d, pairs), no_vocab(s), size, M)


def member_vectors(s: SparkSession, d: str, pairs: DataFrame | None = None, chosen: DataFrame | None = None) -> DataFrame:
    """(manifest_id, site_id, coord, value) of the member sites with texts."""
    pairs = pairs or site_pairs(s, d)
    members = in_role(s, d, "target_member")
    present = members.join(texts(s, d).select("site_id").distinct(), "site_id", "left_semi")
    return tokens.candidate_vectors(pairs.join(members, "site_id"), present, chosen or candidates(s, d, pairs), M)


def public_norms(s: SparkSession, d: str, pairs: DataFrame | None = None, chosen: DataFrame | None = None) -> DataFrame:
    pairs = pairs or site_pairs(s, d)
    own = public_pairs(s, d, pairs)
    return privacy.site_norms(tokens.candidate_vectors(own, own.select(M, "site_id"), chosen or candidates(s, d, pairs), M), M)


def six(df: DataFrame) -> DataFrame:
    """Doubles rounded for comparison across engines."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def supplier_cells(s: SparkSession, d: str) -> DataFrame:
    """A benchmark grid: clients by K with mean times, from the line items."""
    rows = table(s, d, "lineitem")
    clients, k = F.pow(F.lit(2), F.col("l_linenumber") - 1).cast("int"), F.pow(F.lit(2), F.lit(7) + F.col("l_suppkey") % 4).cast("int")
    return rows.groupBy(clients.alias("clients"), k.alias("k")).agg(F.avg(F.col("l_extendedprice") / 1000).alias("seconds"))


# ---- queries ------------------------------------------------------------------------------------------------------

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _QUERIES[function.__name__] = function
    return function


@query
def corpus_reason_histogram(s, d):
    return corpus.reason_histogram(checked(s, d))


@query
def corpus_valid_text_stats(s, d):
    t = F.col("text")
    rows = checked(s, d).where("reason IS NULL")
    return six(rows.agg(F.count("*").alias("n"), F.sum(F.length(t)).alias("chars"), F.sum(F.octet_length(t)).alias("bytes"), F.sum(T.letter_count(t)).alias("letters"), F.sum(T.ascii_letter_count(t)).alias("ascii_letters"), exact_percentile(F.length(t), 0.5).alias("p50"), exact_percentile(F.length(t), 0.95).alias("p95")))


@query
def corpus_first_occurrence(s, d):
    return corpus.first_occurrences(accepted(s, d).select("norm_hash", "idx", "site_id"), "norm_hash", "idx").select("idx", "site_id")


@query
def corpus_dup_within_cross(s, d):
    return corpus.duplicate_kinds(accepted(s, d).select("norm_hash", "idx", "site_id"), "norm_hash", "idx")


@query
def corpus_site_cap(s, d):
    first = corpus.first_occurrences(accepted(s, d).select("norm_hash", "idx", "site_id"), "norm_hash", "idx")
    return corpus.capped(first, "site_id", "idx", 20).select("idx", "site_id")


@query
def corpus_sequential(s, d):
    return corpus.retained_sequential(accepted(s, d), 20).select("idx", "site_id")


@query
def corpus_site_qualified(s, d):
    return corpus.qualified_sites(accepted(s, d), "site_id", 10)


@query
def corpus_scan_limit(s, d):
    return corpus.scan_limit(accepted(s, d).select("idx", "site_id"), 10, 8, 5, 4)


@query
def corpus_bounded_scan(s, d):
    return records(s, d, where="source_record_index < 1000").agg(F.count("*").alias("n"), F.max("idx").alias("last"))


@query
def corpus_scale_sites(s, d):
    return corpus.choose_sites(corpus.qualified_sites(accepted(s, d), "site_id", 1), SEED, {"main": (10, 16), "development": (5, 8)})


@query
def corpus_site_counts(s, d):
    return accepted(s, d).groupBy("site_id").agg(F.count("*").alias("n"))


@query
def corpus_text_totals(s, d):
    return corpus.site_text_totals(texts(s, d))


@query
def corpus_semi_join(s, d):
    """Texts and bytes of the member sites of every manifest; sites are summed up before manifests meet them."""
    member = in_role(s, d, "target_member")
    sums = texts(s, d).join(member, "site_id", "left_semi").groupBy("site_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    return member.join(sums, "site_id").select("manifest_id", "site_id", "n", "bytes")


@query
def corpus_missing_sites(s, d):
    return corpus.missing_sites(roles.manifest_roles(table(s, d, "manifests")), texts(s, d))


@query
def corpus_heldout_texts(s, d):
    """Held-out texts: those of a site that is no member in some manifest."""
    return texts(s, d).join(in_role(s, d, "target_nonmember"), "site_id", "left_semi").select("idx", F.length("text").alias("chars"))


@query
def corpus_content_hashes(s, d):
    rows = records(s, d, "text_sha256", "text").where("text IS NOT NULL")
    return rows.select("idx", F.sha2("text", 256).alias("digest"), F.coalesce(F.lower("text_sha256") == F.sha2("text", 256), F.lit(False)).alias("stored_right"))


@query
def corpus_letter_statistics(s, d):
    t = F.col("text")
    return six(records(s, d).where("text IS NOT NULL").select("idx", F.length(t).alias("chars"), F.octet_length(t).alias("bytes"), T.letter_count(t).alias("letters"), T.letter_ratio(t).alias("ratio")))


@query
def corpus_url_leaks(s, d):
    """Texts with a URL or with a host of their own site."""
    hosts = table(s, d, "sites").select("site_id", "host").dropna().distinct()
    rows = texts(s, d).join(hosts, "site_id")
    return rows.where(T.leaks_source(F.col("text"), F.col("host"))).select("idx").distinct()


@query
def corpus_normalized_hash(s, d):
    """NFKC and case folding; SQL engines lack both, so rows only."""
    return records(s, d).where("text IS NOT NULL").select("idx", F.sha2(T.normalized(F.col("text")), 256).alias("normalized"))


@query
def corpus_audit(s, d):
    return audit.corpus_audit(records(s, d, "site_id", "text", "text_sha256", "char_count", "byte_count"))


@query
def raw_host_sites(s, d):
    rows = table(s, d, "raw_stream").select("source_record_index", T.normal_host(F.col("url")).alias("host")).distinct().where("host IS NOT NULL")
    return rows.groupBy("host").agg(F.count("*").alias("n")).withColumn("site_id", T.site_of_host(F.col("host")))


@query
def raw_rejected_hosts(s, d):
    rows = table(s, d, "raw_stream").select("source_record_index", "url").distinct()
    return rows.groupBy(F.when(T.normal_host(F.col("url")).isNull(), "invalid_url").otherwise("host").alias("kind")).agg(F.count("*").alias("n"))


@query
def raw_outcomes(s, d):
    return table(s, d, "raw_stream").select("source_record_index", "outcome").distinct().groupBy("outcome").agg(F.count("*").alias("n"))


@query
def raw_url_hashes(s, d):
    rows = table(s, d, "raw_stream").where("url IS NOT NULL").select("source_record_index", "url").distinct()
    return rows.select("source_record_index", F.sha2("url", 256).alias("url_sha256"))


@query
def site_hash_rank(s, d):
    return roles.hash_ranked(accepted(s, d), "final:main", SEED).select("site_id", "key", "rank")


@query
def site_roles(s, d):
    return roles.role_slices(accepted(s, d), SEED)


@query
def role_overlap_audit(s, d):
    return audit.overlapping_roles(roles.manifest_roles(table(s, d, "manifests")))


@query
def manifest_partition_audit(s, d):
    """Sites of the target pool that are no member or nonmember, and the reverse."""
    r = roles.manifest_roles(table(s, d, "manifests"))
    pool = r.where("role = 'target_pool'").select("manifest_id", "site_id")
    split = r.where("role IN ('target_member', 'target_nonmember')").select("manifest_id", "site_id").distinct()
    return reporting.missing_cells(pool, split, ["manifest_id", "site_id"])


@query
def shadow_coverage_audit(s, d):
    r = roles.manifest_roles(table(s, d, "manifests")).where("role = 'target_pool'").select("manifest_id", "site_id")
    return audit.uncovered_sites(roles.shadow_training(table(s, d, "manifests")), r, "manifest_id").select("manifest_id", "site_id", "n")


@query
def balanced_probes(s, d):
    return roles.balanced_probes(in_role(s, d, "target_pool"), 16, SEED, M)


@query
def probe_balance_audit(s, d):
    """Target sites that do not train exactly half of the first two and four shadows of their manifest."""
    return audit.unbalanced_probes(training(s, d).join(in_role(s, d, "target_pool"), [M, "site_id"], "left_semi"), [2, 4], M)


@query
def auxiliary_groups(s, d):
    return roles.auxiliary_groups(in_role(s, d, "shadow_auxiliary"), 4, 5, SEED, M)


@query
def involved_sites(s, d):
    """Sites of the first two shadow plans of every manifest, once each."""
    return roles.shadow_training(table(s, d, "manifests")).where("shadow_id < 2").select("manifest_id", "site_id").distinct()


@query
def nonmember_except(s, d):
    return in_role(s, d, "target_pool").exceptAll(in_role(s, d, "target_member")).distinct()


@query
def stratified_split(s, d):
    rows = table(s, d, "subject_labels").where("subject IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.lower(F.trim("subject")).alias("label")).groupBy("doc_id").agg(F.min("label").alias("label"))
    return roles.stratified_split(rows, "label", "doc_id", SEED, 0.1).select("doc_id", "label", "split")


@query
def split_priority_dedupe(s, d):
    docs = table(s, d, "documents").where("text IS NOT NULL").select(F.sha2(T.collapsed(F.col("text")), 256).alias("h"), "doc_id")
    parts = [(n, docs.where(F.pmod("doc_id", F.lit(10)).isin(*k))) for n, k in (("test", (0,)), ("validation", (1,)), ("train", (2, 3, 4, 5, 6, 7, 8, 9)))]
    return roles.split_priority(parts, "h", "doc_id").select("h", "doc_id", "split")


@query
def class_histogram(s, d):
    return stratified_split(s, d).groupBy("split", "label").agg(F.count("*").alias("n"))


@query
def unit_frequency_topk(s, d):
    return tokens.top_units_as_vocab(tokens.unit_counts(texts(s, d)), 500)


@query
def unit_counts_by_site(s, d):
    return tokens.unit_counts(texts(s, d), "site_id").groupBy("site_id").agg(F.count("*").alias("distinct_units"), F.sum("cnt").alias("units"))


@query
def sentence_stats(s, d):
    rows = texts(s, d).select(F.explode(T.sentence_list(F.col("text"))).alias("x"))
    return six(rows.agg(F.count("*").alias("sentences"), F.avg(F.length("x")).alias("mean_chars"), F.median(F.length("x")).cast("double").alias("median_chars")))


@query
def rare_words(s, d):
    return tokens.word_frequencies(texts(s, d)).where("cnt <= 2").groupBy("cnt").agg(F.count("*").alias("words"))


@query
def alphabet(s, d):
    return tokens.alphabet(unit_table(s, d).join(in_role(s, d, "public_candidate"), "site_id"), tokens.SPECIAL_TOKENS, M)


@query
def pair_counts_two_levels(s, d):
    return tokens.pair_counts_two_levels(words(s, d)).groupBy("site_id").agg(F.count("*").alias("pairs"), F.sum("cnt").alias("total"), F.max("cnt").alias("most"))


@query
def pair_topk(s, d):
    return candidates(s, d, site_pairs(s, d))


@query
def candidate_vectors(s, d):
    return member_vectors(s, d)


@query
def public_site_norms(s, d):
    return public_norms(s, d)


@query
def public_clip_bound(s, d):
    return privacy.clip_bound(public_norms(s, d), 0.75, M)


@query
def l1_clip(s, d):
    return privacy.l1_clip(member_vectors(s, d), 500, M)


@query
def clipped_vector_sum(s, d):
    return privacy.coordinate_sums(privacy.l1_clip(member_vectors(s, d), 500, M), M)


@query
def plain_vector_sum(s, d):
    return privacy.coordinate_sums(member_vectors(s, d), M)


@query
def substring_counts(s, d):
    e = experiment(s, d)
    return e.counts.join(e.present, [M, "site_id"], "left_semi").groupBy(M, "site_id").agg(F.count("*").alias("tokens"), F.sum("cnt").alias("total"))


@query
def global_token_counts(s, d):
    return site_tokens(s, d).groupBy("token").agg(F.sum("cnt").alias("cnt"))


@query
def background_counts(s, d):
    packed = bags(s, d)
    return unitbags.background(packed, packed_target(s, d, packed), involved(s, d), M)


@query
def vocab_truncate(s, d):
    return tokens.truncated_vocab(target_vocab(s, d), 300, M)


@query
def min_count_filter(s, d):
    """Three thresholds from one count."""
    e = experiment(s, d)
    return tokens.min_count_vocab(e.vocab, e.background, [10, 50, 200], tokens.SPECIAL_TOKENS, M)


@query
def merge_validity(s, d):
    """Candidate pairs as merges, kept where parts and product are all among the most frequent units and characters."""
    vocab = target_vocab(s, d).select(M, "token").unionByName(alphabet(s, d).select(M, "token"))
    return tokens.valid_merges(candidates(s, d, site_pairs(s, d), 2000).select(M, "coord", "left", "right"), vocab, M)


@query
def vocab_jaccard(s, d):
    target, shadow = packed_vocabs(s, d)
    own = [M, "shadow_id"]
    common = shadow.join(target.select(M, "token"), [M, "token"]).groupBy(*own).agg(F.count("*").alias("c"))
    rows = shadow.groupBy(*own).agg(F.count("*").alias("n")).join(common, own, "left").fillna({"c": 0})
    size = target.groupBy(M).agg(F.count("*").alias("m"))
    return six(rows.join(size, M).select(*own, jaccard(F.col("c"), F.col("n"), F.col("m")).alias("jaccard")))


@query
def shadow_overlap_score(s, d):
    return six(attacks.overlap_scores(*packed_vocabs(s, d), training(s, d), in_role(s, d, "target_pool"), M))


@query
def rank_correlation(s, d):
    return six(attacks.rank_correlations(*packed_vocabs(s, d), M))


@query
def merge_similarity_score(s, d):
    return six(attacks.merge_similarity_scores(attacks.rank_correlations(*packed_vocabs(s, d), M), training(s, d), in_role(s, d, "target_pool"), M))


def one_law(s: SparkSession, d: str) -> DataFrame:
    """The same power law for every manifest: the parameters of the queries that SQL can follow."""
    return table(s, d, "manifests").select(M).distinct().withColumns({"alpha": F.lit(1.2), "xmin": F.lit(5)})


@query
def zipf_rarity(s, d):
    return six(attacks.zipf_rarity(target_vocab(s, d), one_law(s, d), M))


@query
def frequency_score(s, d):
    """With one power law, see attack_results for fitted ones."""
    packed = bags(s, d)
    vocab = packed_target(s, d, packed)
    background = unitbags.background(packed, vocab, involved(s, d), M)
    return six(unitbags.frequency_scores(packed, background, attacks.zipf_rarity(vocab, one_law(s, d), M), involved(s, d), in_role(s, d, "target_pool"), M))


@query
def naive_bayes_score(s, d):
    e = experiment(s, d, 500)
    return six(attacks.naive_bayes_scores(e.counts.join(e.present, [M, "site_id"], "left_semi"), e.background, involved(s, d), e.vocab, e.present, 500, M))


@query
def site_compression_score(s, d):
    """Bytes by unit, with units as tokens."""
    counts = tokens.unit_counts(texts(s, d), "site_id").groupBy("site_id").agg(F.sum("cnt").alias("tokens"))
    some = texts(s, d).join(counts.select("site_id"), "site_id", "left_semi")
    return six(attacks.compression_scores(some, counts))


def _compression_labels(s, d):
    """Compression scores of the target sites of every manifest with their membership there."""
    member = in_role(s, d, "target_member").withColumn("m", F.lit(1))
    rows = in_role(s, d, "target_pool").join(site_compression_score(s, d), "site_id").join(member, ["manifest_id", "site_id"], "left")
    return rows.select(F.col("manifest_id").cast("string").alias("run_id"), "site_id", F.coalesce("m", F.lit(0)).alias("label"), "score")


@query
def site_compression_auc(s, d):
    return six(metrics.scalar_metrics(_compression_labels(s, d), "run_id"))


@query
def labelled_scores(s, d):
    return _compression_labels(s, d)


@query
def attack_metrics(s, d):
    return six(metrics.scalar_metrics(scores(s, d), "run_id"))


@query
def roc_curve(s, d):
    return six(metrics.roc_curve(scores(s, d), "run_id"))


@query
def pr_curve(s, d):
    return six(metrics.pr_curve(scores(s, d), "run_id"))


@query
def mean_roc_on_grid(s, d):
    grid = metrics.interpolated_roc(metrics.roc_curve(scores(s, d), "run_id"), 501, "run_id").withColumn("attack", F.regexp_extract("run_id", r"^run_\d+_(.*)$", 1))
    rows = grid.groupBy("attack", F.round("x", 4).alias("x")).agg(F.avg("tpr").alias("mean"), sample_sd(F.col("tpr")).alias("sd"))
    return six(rows.select("attack", "x", "mean", F.greatest(F.lit(0.0), F.col("mean") - F.col("sd")).alias("low"), F.least(F.lit(1.0), F.col("mean") + F.col("sd")).alias("high")))


@query
def bootstrap_ci(s, d):
    return six(metrics.bootstrap_intervals(scores(s, d), "run_id", iterations=200, seed=SEED))


def _methods(s, d):
    """The scores of two attacks: (manifest, site_id, label, score) each, the greatest of repeated ones."""
    rows = scores(s, d).withColumn("manifest", F.regexp_extract("run_id", r"^run_(\d+)_", 1)).withColumn("attack", F.regexp_extract("run_id", r"^run_\d+_(.*)$", 1))
    best = rows.groupBy("manifest", "attack", "site_id").agg(F.max("label").alias("label"), F.max("score").alias("score"))
    return tuple(best.where(F.col("attack") == x).drop("attack") for x in ("compression", "frequency_estimation"))


@query
def paired_difference(s, d):
    """Manifests and sites that pair; what does not is in paired_conflicts."""
    a, b = _methods(s, d)
    bad = metrics.pairing_conflicts(a, b, "manifest").select("manifest", "site_id")
    a, b = (x.join(bad, ["manifest", "site_id"], "left_anti") for x in (a, b))
    return six(metrics.paired_rows(a, b, "manifest").groupBy("manifest").agg(F.count("*").alias("n"), F.avg(F.col("score_a") - F.col("score_b")).alias("difference")))


@query
def paired_conflicts(s, d):
    return metrics.pairing_conflicts(*_methods(s, d), "manifest")


@query
def paired_bootstrap(s, d):
    a, b = _methods(s, d)
    bad = metrics.pairing_conflicts(a, b, "manifest").select("manifest", "site_id")
    a, b = (x.join(bad, ["manifest", "site_id"], "left_anti") for x in (a, b))
    return six(metrics.paired_auc_bootstrap(metrics.paired_rows(a, b, "manifest"), "manifest", iterations=200, seed=SEED))


@query
def method_attack_aggregate(s, d):
    return six(reporting.mean_and_sd(run_metrics(s, d), "roc_auc", "attack"))


@query
def direction_adapted_auc(s, d):
    best, deviation = reporting.direction_adapted(F.col("roc_auc"))
    return six(run_metrics(s, d).groupBy("attack").agg(F.avg(best).alias("adapted"), F.avg(deviation).alias("deviation")))


@query
def attack_matrix(s, d):
    names = ["compression", "frequency_estimation", "merge_similarity", "naive_bayes"]
    return six(reporting.matrix(run_metrics(s, d), "manifest", "attack", "roc_auc", names))


@query
def strongest_attack(s, d):
    return six(reporting.strongest(run_metrics(s, d).select("manifest", "attack", F.round("roc_auc", 9).alias("roc_auc")), "manifest", "attack", "roc_auc"))


@query
def scale_sweep(s, d):
    """Attack means by scale and seed: runs joined with the manifests' parameters."""
    plans = table(s, d, "manifests").select(F.col("manifest_id").alias("manifest"), "scale_name", "seed").distinct()
    return six(reporting.mean_and_sd(run_metrics(s, d).join(plans, "manifest"), "roc_auc", "scale_name", "attack"))


@query
def numeric_registry(s, d):
    return six(reporting.numeric_registry(run_metrics(s, d), ["run_id"], [*metrics.SCALARS, "attack"]))


@query
def expected_matrix_missing(s, d):
    runs = run_metrics(s, d).select("manifest", "attack").distinct()
    ids = table(s, d, "manifests").select(F.col("manifest_id").alias("manifest")).distinct()
    expected = ids.crossJoin(F.broadcast(matrix.product(s, attack=["compression", "frequency_estimation", "merge_similarity", "naive_bayes", "vocabulary_overlap"])))  # five rows
    return reporting.missing_cells(expected, runs, ["manifest", "attack"])


@query
def run_balance(s, d):
    return audit.run_balance(table(s, d, "attack_details").where("run_id IS NOT NULL"))


@query
def non_finite_scores(s, d):
    return audit.non_finite(table(s, d, "attack_details")).groupBy("run_id").agg(F.count("*").alias("n"))


@query
def duplicate_result_keys(s, d):
    return reporting.duplicate_keys(table(s, d, "attack_details"), "run_id", "site_id")


@query
def delivery_delays(s, d):
    rows = table(s, d, "raw_stream").where("fetched_at IS NOT NULL").distinct().select("outcome", (F.unix_micros(F.col("arrived_at").cast("timestamp")) - F.unix_micros(F.col("fetched_at").cast("timestamp"))).cast("double").alias("micros"))
    return six(reporting.timing_distribution(rows.withColumn("seconds", F.round(F.col("micros") / 1e6, 3)), "seconds", "outcome"))


@query
def pareto_front(s, d):
    rows = table(s, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("price"), F.avg("p_size").alias("size"), F.count("*").alias("n"))
    return six(reporting.pareto_front(rows.select("p_brand", F.round("price", 6).alias("price"), F.round("size", 6).alias("size"), F.col("n").cast("double").alias("n")), "p_brand", ["price", "size"]))


@query
def objective_shortlist(s, d):
    rows = table(s, d, "part").select("p_partkey", F.col("p_type").alias("mode"), "p_size", "p_retailprice")
    return reporting.shortlist(rows, "mode", ["p_size", "p_retailprice", "p_partkey"])


@query
def primary_secondary(s, d):
    rows = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("mode"), "p_size", "p_retailprice")
    return reporting.primary_and_secondary(rows, "mode", ["p_size", "p_retailprice", "id"], "p_retailprice", "id")


@query
def utility_limits(s, d):
    rows = table(s, d, "part").select("p_partkey", (F.col("p_size") / 100.0).alias("token_increase"), (F.col("p_retailprice") % 7).alias("f1_drop"))
    return reporting.admissible(rows).groupBy("admissible").agg(F.count("*").alias("n"))


@query
def one_factor_grid(s, d):
    return reporting.one_factor_grid(s, {"k": "1024", "b": "32", "clip": "P75"}, {"k": ["512", "1024", "2048"], "b": ["16", "64"], "clip": ["P50", "P75", "P90"]})


@query
def configuration_ids(s, d):
    return table(s, d, "part").select("p_partkey", matrix.configuration_id(F.col("p_type"), ("eps", F.col("p_size")), ("k", F.col("p_partkey"))).alias("id"))


@query
def attack_task_matrix(s, d):
    return matrix.attack_tasks(s, [SEED, SEED + 1, SEED + 2], [4000, 8000, 16000, 32000], ["plain", "min2", "sa_dp"])


@query
def ordered_methods(s, d):
    rows = table(s, d, "lineitem").select(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("method"), "l_orderkey")
    return matrix.ordered_distinct(rows, "method", "l_orderkey")


def _predictions(s, d):
    rows = table(s, d, "orders").select((F.col("o_custkey") % 4).cast("int").alias("label"), "o_orderkey", "o_totalprice")
    return rows.withColumn("prediction", F.when(F.col("o_orderkey") % 3 == 0, (F.col("label") + 1) % 4).otherwise(F.col("label")))


@query
def class_scores(s, d):
    return six(reporting.class_scores(_predictions(s, d)))


@query
def macro_f1(s, d):
    return six(reporting.macro_scores(_predictions(s, d)))


@query
def best_epoch(s, d):
    rows = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("epoch")).agg(F.max("l_extendedprice").alias("f1"))
    return reporting.best_so_far(rows, "run", "epoch", "f1")


@query
def epsilon_accounting(s, d):
    rounds = table(s, d, "lineitem").select("l_returnflag", "l_linestatus", F.round(F.col("l_discount") + 0.01, 2).alias("epsilon"))
    return six(privacy.accounting(rounds, "l_returnflag", "l_linestatus"))


@query
def bytes_accounting(s, d):
    cells = supplier_cells(s, d).select("clients", "k")
    return paillier.message_bytes(cells, 2048)


@query
def resource_extrapolation(s, d):
    rows = table(s, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", "target").otherwise("shadow").alias("role"), F.col("l_quantity").alias("elapsed_seconds"), F.col("l_partkey").alias("artifact_bytes"))
    return six(reporting.resource_extrapolation(rows, 8, 96))


@query
def cost_grid(s, d):
    grid = matrix.product(s, clients=[1, 2, 4, 8, 16, 32, 64, 128], k=[128, 256, 512, 1024, 2048])
    return six(reporting.merged_grid(grid, supplier_cells(s, d), ["clients", "k"], "seconds", F.col("clients") * F.col("k") / 1000.0))


@query
def cost_matrix(s, d):
    return six(reporting.matrix(supplier_cells(s, d), "clients", "k", "seconds", ["128", "256", "512", "1024"]))


@query
def cost_unpivot(s, d):
    wide = table(s, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("encrypt"), F.avg("l_discount").alias("noise"), F.avg("l_tax").alias("decrypt"))
    return six(reporting.unpivoted(wide, ["l_returnflag"], ["encrypt", "noise", "decrypt"], "stage", "seconds"))


@query
def cost_regression(s, d):
    cells = supplier_cells(s, d)
    x = F.col("clients") * F.col("k").cast("double")
    return six(cells.agg(F.regr_slope("seconds", x).alias("slope"), F.regr_intercept("seconds", x).alias("intercept"), F.regr_r2("seconds", x).alias("r2")))


@query
def scaling_models(s, d):
    return six(reporting.scaling_models(supplier_cells(s, d), "seconds"))


@query
def method_labels(s, d):
    label = reporting.method_label(F.col("l_returnflag"), {"A": "Plain BPE", "R": "Local DP"})
    return table(s, d, "lineitem").groupBy(label.alias("method")).agg(F.count("*").alias("n"))


@query
def bpe_train(s, d):
    """Target tokenizers of every manifest: (manifest_id, token, id)."""
    return bpe.vocabularies(gathered.targets(gathered.train(bags(s, d), gathered.members(all_roles(s, d)), 600, 300)), M)


@query
def bpe_shadows(s, d):
    """Shadow tokenizers of every manifest: (manifest_id, shadow_id, token, id)."""
    return bpe.vocabularies(gathered.train(bags(s, d), gathered.shadows(training(s, d)), 600, 300), M, "shadow_id")


@query
def bpe_derived(s, d):
    """Merges of the target tokenizers cut to 400 tokens: (manifest_id, n, left, right)."""
    full = checkpointed(gathered.targets(gathered.train(bags(s, d), gathered.members(all_roles(s, d)), 600, 300)))
    small = bpe.derive_each(full, tokens.truncated_vocab(bpe.vocabularies(full, M), 400, M), M)
    return small.where("kind = 'merge'").select(M, "n", "left", "right")


@query
def bpe_encode(s, d):
    """Compression of the pool sites of every manifest by its target tokenizer."""
    manifest = all_roles(s, d)
    found = gathered.site_tokens(bags(s, d), gathered.members(manifest).unionByName(gathered.pool(manifest)), 600)
    used = texts(s, d).join(in_role(s, d, "target_pool").select("site_id").distinct(), "site_id", "left_semi")
    return six(attacks.compression_scores(used, found, M))


@query
def attack_results(s, d):
    """The five metrics of the five attacks on trained tokenizers with fitted power laws, in every manifest."""
    found = packed_attacks(bags(s, d), texts(s, d), all_roles(s, d), training(s, d), ATTACKED_VOCAB, ATTACKED_VOCAB, AUXILIARY_GROUPS, SCORED_TOKENS)
    runs = metrics.scalar_metrics(metrics.clean_scores(found, "run_id"), "run_id")
    return six(runs.select(F.regexp_extract("run_id", r"^run_(\d+)_", 1).cast("bigint").alias(M), F.regexp_extract("run_id", r"^run_\d+_(.*)$", 1).alias("attack"), *metrics.SCALARS))


@query
def tokenizer_utility(s, d):
    """Measures of every manifest's target tokenizer on its nonmember texts."""
    manifest = all_roles(s, d)
    parts = gathered.members(manifest).unionByName(gathered.pool(manifest, "target_nonmember"))
    return six(gathered.utility(texts(s, d), bags(s, d), parts, 600))


@query
def zipf_fit(s, d):
    """The power law of every manifest's first shadow vocabulary over its training sites."""
    units = shared_units(s, d)
    vocab = checkpointed(shadow_vocab(s, d, units).where("shadow_id = 0").select(M, "token", "id"))
    sites = training(s, d).where("shadow_id = 0").select(M, "site_id").distinct()
    counts = site_tokens(s, d, units, vocab).join(sites, "site_id").groupBy(M, "token").agg(F.sum("cnt").alias("cnt"))
    return six(attacks.fit_zipf(vocab, counts, M))


@query
def private_round(s, d):
    """The first round of private training in every manifest and mode: (manifest_id, mode, place, left, right)."""
    pairs = site_pairs(s, d)
    chosen = checkpointed(candidates(s, d, pairs))
    bounds = checkpointed(privacy.clip_bound(public_norms(s, d, pairs, chosen), 0.75, M))
    return rounds_by_mode(checkpointed(member_vectors(s, d, pairs, chosen)), chosen, bounds, 8, 1.0, SEED, M)


@query
def private_training(s, d):
    """Two rounds of the private training in the modes that differ in the clear, over all sites: public and private ones are
    those whose hash is even and odd. (mode, pos, left, right)"""
    packed = bags(s, d)
    half = F.pmod(F.xxhash64("site_id"), F.lit(2))
    out = []
    letters = len(bagpairs.letters(packed.where(half == 0)))
    for mode in ("plain", "local_dp", "sa_dp"):
        t = PrivateTraining(packed.where(half == 0), packed.where(half == 1), letters + len(tokens.SPECIAL_TOKENS) + 16, mode, 64, 8, 4.0 if mode in ("local_dp", "sa_dp") else None, seed=SEED)
        out += [(mode, k, a, b) for k, (a, b) in enumerate(t.run().merges)]
    return s.createDataFrame(out, "mode string, pos int, left string, right string")


@query
def encrypted_sum(s, d):
    """Sums of all coordinates over encrypted member vectors of every manifest equal the plain ones."""
    key = paillier.generate_keys(1024)
    vectors = checkpointed(member_vectors(s, d))
    sums = paillier.encrypted_sums(paillier.encrypted_packed(vectors, key.public, M), key.public, M)
    wide = {r[M]: r["k"] for r in vectors.groupBy(M).agg((F.max("coord") + 1).alias("k")).collect()}  # a row a manifest
    values = [x for v in paillier.decrypted(sums, key, M) for x in paillier.unpacked([v], wide[v[0]], key.public)]
    return s.createDataFrame(values, f"{M} bigint, coord int, value bigint")


@query
def final_corpus(s, d):
    return build.final_corpus(records(s, d), corpus.Validity(), 5, 20, 40, SEED).select("idx", "site_id", "char_count", "byte_count")


@query
def built_manifest(s, d):
    return build.manifest(accepted(s, d), SEED)


@query
def classifier_metrics(s, d):
    """The classifier substitute on the hand-made labels, scored on a hash-drawn split."""
    labels = stratified_split(s, d)
    names = labels.select("label").distinct().withColumn("y", F.rank().over(Window.orderBy("label")) - 1)  # ten subjects
    docs = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", T.word_list(F.col("text")).alias("tokens"))
    rows = classifier.features(docs.join(labels, "doc_id").join(F.broadcast(names), "label").drop("label").withColumnRenamed("y", "label"), "tokens", 1 << 12)
    model, _ = classifier.trained(rows.where("split = 'train'"), rows.where("split = 'validation'"), (0.01,), 15)
    return six(reporting.macro_scores(model.transform(rows.where("split = 'validation'"))))


@query
def events_windowed(s, d):
    return six(streams.windowed_counts(table(s, d, "events"), "ts", "event_type", "value"))


@query
def events_sessions(s, d):
    return streams.session_counts(table(s, d, "events"), "ts", "user_id")


@query
def site_index(s, d):
    return artifacts.site_index(texts(s, d))


@query
def retained_audit(s, d):
    """What the accepted texts must not have."""
    rows = accepted(s, d).select("idx", "site_id", "text", F.sha2("text", 256).alias("digest"), F.col("norm_hash").alias("norm"))
    return artifacts.retained_audit(checkpointed(rows))


@query
def manifest_audit(s, d):
    return artifacts.manifest_audit(all_roles(s, d), artifacts.plan_lists(table(s, d, "manifests")))


@query
def sql_views(s, d):
    """Units by manifest and membership through the SQL front-end."""
    artifacts.register_views(s, d, ["stream_final_c4", "manifests"])
    return s.sql("SELECT manifest_id, is_member, sum(cnt) AS units, count(DISTINCT site_id) AS sites FROM corpus_units JOIN target_sites USING (site_id) GROUP BY manifest_id, is_member")


@query
def benchmark_summary(s, d):
    """Cells of a benchmark from the line items: clients by line, k by supplier, repetitions by order."""
    rows = table(s, d, "lineitem").where("l_linenumber <= 4")
    clients, k = F.pow(F.lit(2), F.col("l_linenumber") - 1).cast("int"), F.pow(F.lit(2), F.lit(7) + F.col("l_suppkey") % 4).cast("int")
    rounds = rows.groupBy(clients.alias("clients"), k.alias("k"), (F.col("l_orderkey") % 20).alias("repetition")).agg(F.avg("l_extendedprice").alias("total"), F.avg("l_quantity").alias("encrypt"), F.avg("l_tax").alias("sum"))
    expected = matrix.product(s, clients=[1, 2, 4, 8, 16], k=[128, 256, 512, 1024])
    return six(artifacts.benchmark_summary(rounds, expected, 20, ("encrypt", "sum")))


@query
def benchmark_measured(s, d):
    """Whether the encrypted rounds of a small measured matrix are complete: (clients, k, repetitions, complete)."""
    key = paillier.generate_keys(1024)
    rounds = artifacts.benchmark_matrix(lambda c, k, seed: paillier.benchmark_cell(s, c, k, 4, key, seed), [2, 4], [16], 0, 2)
    frame = s.createDataFrame([(r["clients"], r["k"], r["repetition"], float(r["total"]), *(float(r[x]) for x in artifacts.STAGES)) for r in rounds], "clients int, k int, repetition int, total double, " + ", ".join(f"{x} double" for x in artifacts.STAGES))
    return artifacts.benchmark_summary(frame, matrix.product(s, clients=[2, 4], k=[16]), 2).select("clients", "k", "repetitions", "complete")


@query
def grouped_report(s, d):
    plans = table(s, d, "manifests").select(F.col("manifest_id").alias("manifest"), "scale_name").distinct()
    return artifacts.grouped_report(run_metrics(s, d).join(plans, "manifest"), ("roc_auc", "balanced_accuracy"), "scale_name", "attack")


@query
def pilot_summary(s, d):
    """Runs with their intervals against the expected matrix of manifests and attacks."""
    runs = run_metrics(s, d)
    bounds = metrics.bootstrap_intervals(scores(s, d), "run_id", iterations=200, seed=SEED).join(runs.select("run_id", "manifest", "attack"), "run_id")
    expected = table(s, d, "manifests").select(F.col("manifest_id").alias("manifest")).distinct().crossJoin(F.broadcast(matrix.product(s, attack=["compression", "frequency_estimation"])))  # two rows
    return six(artifacts.pilot_summary(runs, bounds, expected, ["manifest", "attack"], metrics.SCALARS))


@query
def parameter_sweeps(s, d):
    """Mean AUC by each parameter of the manifests: (parameter, value, attack, n, mean, sd)."""
    own = [F.col(c).cast("string").alias(c) for c in ("scale_name", "seed", "minimum_texts_per_site", "maximum_texts_per_site")]
    plans = table(s, d, "manifests").select(F.col("manifest_id").alias("manifest"), *own).distinct()
    wide = run_metrics(s, d).select("manifest", "attack", "roc_auc").join(plans, "manifest")
    rows = wide.unpivot(["manifest", "attack", "roc_auc"], ["scale_name", "seed", "minimum_texts_per_site", "maximum_texts_per_site"], "parameter", "value")
    return six(reporting.mean_and_sd(rows, "roc_auc", "parameter", "value", "attack"))


@query
def sigmoid_scores(s, d):
    return six(scores(s, d).select("run_id", "site_id", T.sigmoid(F.col("score")).alias("p")))


@query
def fixed_length_ids(s, d):
    """Rows of token ids brought to 16, with a class, a separator, padding and unknown ids."""
    ids = table(s, d, "part").select("p_partkey", F.sequence(F.lit(1), F.col("p_size")).alias("ids"))
    return tokens.fixed_length(ids, 16, 101, 102, 0, 100, 40)


@query
def measured_means(s, d):
    """Bootstrapped means of delivery seconds by outcome."""
    rows = table(s, d, "raw_stream").where("fetched_at IS NOT NULL").distinct().select("outcome", (F.unix_micros(F.col("arrived_at").cast("timestamp")) - F.unix_micros(F.col("fetched_at").cast("timestamp"))).cast("double").alias("x"))
    return six(metrics.bootstrap_mean(rows, "outcome", "x", 100, SEED))


def _method_runs(s, d):
    rows = table(s, d, "lineitem")
    return rows.select(F.when(F.col("l_returnflag") == "N", "plain").otherwise(F.col("l_returnflag")).alias("method_id"), F.col("l_discount").alias("roc_auc"), F.col("l_quantity").alias("token_count"), F.col("l_tax").alias("best_validation_macro_f1"), F.lit(False).alias("test_used_for_model_selection"))


@query
def shortlist_inputs(s, d):
    rows = _method_runs(s, d)
    return six(reporting.shortlist_inputs(rows, rows))


@query
def validation_means(s, d):
    return six(reporting.validation_means(_method_runs(s, d)))


@query
def pareto_costs(s, d):
    rows = _method_runs(s, d)
    return six(reporting.pareto_costs(rows, "method_id", "plain", "token_count", "roc_auc"))


@query
def noisy_sums(s, d):
    """Sums over all manifests with a given noise, and the noise beside them."""
    sums = privacy.coordinate_sums(member_vectors(s, d).select("coord", "value"))
    noise = s.range(CANDIDATES).select(F.col("id").cast("int").alias("coord"), (F.col("id") % 7 - 3).alias("noise"))
    return privacy.with_noise(sums, noise)


@query
def interval_audit(s, d):
    rows = table(s, d, "part").select("p_partkey", F.col("p_retailprice").alias("value"), F.lit(950.0).alias("lower"), F.lit(1500.0).alias("upper"), F.when(F.col("p_size") > 45, "guessed").otherwise("measured").alias("data_source"))
    return audit.bad_intervals(rows).select("p_partkey")


@query
def development_sites(s, d):
    """Development candidates with the main candidates that were not taken."""
    counts = accepted(s, d).groupBy("site_id").agg(F.count("*").alias("n"))
    main = counts.where("n >= 10").select("site_id")
    return build.development_sites(counts.where("n BETWEEN 3 AND 6"), main, main.where(F.col("site_id") < "site_8"))


@query
def search_plan(s, d):
    return build.search_plan(s, {"sa_dp": {"k": ["512", "1024"], "b": ["16"]}, "plain": {"b": ["64"]}}, {"k": "1024", "b": "32"})


@query
def pilot_plans(s, d):
    """Strict shadow plans over the target and auxiliary sites of every manifest: (manifest_id, shadow_id, site_id)."""
    lists = all_roles(s, d).where("role IN ('target_pool', 'shadow_auxiliary')").groupBy(M).pivot("role", ["target_pool", "shadow_auxiliary"]).agg(F.collect_set("site_id"))
    out = [(r[M], p["shadow_id"], site) for r in lists.collect() for p in build.pilot_plans(r["target_pool"] or [], r["shadow_auxiliary"] or [], 4, SEED, True) for site in p["training_site_ids"]]  # experiments are few
    return s.createDataFrame(out, f"{M} bigint, shadow_id int, site_id string")


@query
def merged_units(s, d):
    """Symbols of all units after two merges: (symbol, cnt)."""
    words_ = apply_merges(words(s, d).select("site_id", "symbols", "freq"), [("t", "h"), ("i", "n")])
    return words_.select("freq", F.explode("symbols").alias("symbol")).groupBy("symbol").agg(F.sum("freq").alias("cnt"))


@query
def pair_recount(s, d):
    """Pair counts brought up to date after a round of merges: (left, right, cnt)."""
    own = checkpointed(words(s, d).groupBy("symbols").agg(F.sum("freq").alias("freq")))
    return merge_round(own, checkpointed(tokens.symbol_pairs(own)), [("t", "h"), ("i", "n")])[1].select("left", "right", "cnt")


@query
def predicted_intervals(s, d):
    cells = checkpointed(supplier_cells(s, d))
    rows = [(m, *reporting.predicted_interval(cells, "seconds", m, 96.0, 2048.0, 200, SEED)) for m in reporting.DESIGNS]
    return six(s.createDataFrame(rows, "model string, point double, lower double, upper double"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracles.queries()
