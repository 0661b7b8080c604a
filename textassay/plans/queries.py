"""The registered queries: each operator over whole tables of a corpus.

Labelled texts are ``documents`` joined to ``labels``: toxic is spam, all others
ham. Queries that have a SQL twin hash features by MD5, which every engine has.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import replace
from string import ascii_letters, ascii_lowercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fs import Folder
from ..functions.hashing import HASH_VERSION, feature_hash, slot
from ..functions.shared import cut, shared_folder, spread
from ..operators import features as fx
from ..operators.language import LanguageSet
from ..operators.layers import CountTable, Layer, clamp, label_of, layer_counts
from ..operators.scoring import ratios, verdict
from ..params import ExtractParams, ModelParams
from ..sources import background, catalog
from ..sources.codec import decode_layer, encode_background, encode_layer
from ..sources.store import CountStore
from ..streaming.learning import learn_stream
from .model import EvidenceModel

BITS = 20
SMALL_BITS = 12
MODE = "md5"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, label, quality of labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", label_of(F.col("toxic")).alias("label"), "quality")
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).join(labels, "doc_id")


def counted(texts: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, h and cnt: how often each text has features of a hash."""
    return fx.unpacked(fx.packed(texts, *keep, mode=MODE), *keep)


def labelled_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, h, cnt."""
    return counted(labelled(spark, sf_dir).select("label", "text"), "label")


def corpus(spark: SparkSession, sf_dir: str, labels: bool = True, each: bool = False) -> DataFrame:
    """doc_id, lang and the packed bag of every document, extracted once; with ``labels`` also n_ham and n_spam, how often it is labelled so."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    if not labels:
        return fx.packed(docs, "doc_id", "lang", mode=MODE)
    label = label_of(F.col("toxic"))
    times = table(spark, sf_dir, "labels").groupBy("doc_id").agg(*[F.count(F.when(label == c, 1)).alias(f"n_{c}") for c in ("ham", "spam")])
    docs = spread(docs).join(times, "doc_id", "left").na.fill(0, ["n_ham", "n_spam"])
    return fx.packed(docs, "doc_id", "lang", "n_ham", "n_spam", mode=MODE, each=each)


def layer_of(docs: DataFrame, bits: int = BITS) -> Layer:
    """The layer of labelled documents of a corpus."""
    texts = docs.agg(*[F.coalesce(F.sum(f"n_{c}"), F.lit(0)).alias(c) for c in ("ham", "spam")]).first()
    rows = fx.unpacked(docs.where("n_ham > 0 OR n_spam > 0"), "n_ham", "n_spam")
    of = lambda c: clamp(F.sum(F.col("cnt") * F.col(f"n_{c}"))).alias(f"count_{c}")
    counts = rows.groupBy(slot(F.col("h"), bits).alias("slot")).agg(of("ham"), of("spam")).where("count_ham > 0 OR count_spam > 0")
    return Layer(cut(counts), bits, texts["ham"], texts["spam"]).counted()


def site_layer(spark: SparkSession, sf_dir: str, bits: int = BITS) -> Layer:
    texts = {r["label"]: r["n"] for r in labelled(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n")).collect()}
    counts = cut(layer_counts(labelled_hashes(spark, sf_dir), bits))
    return Layer(counts, bits, texts.get("ham", 0), texts.get("spam", 0)).counted()


def pretrained_layer(spark: SparkSession, sf_dir: str) -> Layer:
    """Conversations as a layer from elsewhere: what users say is spam, all else ham."""
    rows = table(spark, sf_dir, "conversations").withColumn("label", F.when(F.col("role") == "user", F.lit("spam")).otherwise(F.lit("ham")))
    return Layer(cut(layer_counts(counted(rows, "label"), BITS)), BITS).counted()


def languages_of(docs: DataFrame, bits: int = BITS) -> LanguageSet:
    """The languages of a corpus, or of (lang, bag) rows."""
    tables = fx.unpacked(docs.where("lang IS NOT NULL"), "lang").groupBy("lang", slot(F.col("h"), bits).alias("h")).agg(F.sum("cnt").alias("cnt"))
    langs = LanguageSet.build(tables := cut(tables), bits)
    return replace(langs, tables=tables.withColumnRenamed("h", "slot"))


def languages(spark: SparkSession, sf_dir: str) -> LanguageSet:
    return languages_of(fx.packed(table(spark, sf_dir, "documents"), "lang", mode=MODE))


def plain_of(docs: DataFrame) -> CountTable:
    """All documents of a corpus as one table."""
    counts = fx.unpacked(docs).groupBy(slot(F.col("h"), BITS).alias("slot")).agg(F.sum("cnt").alias("cnt"))
    return CountTable.of(cut(counts), BITS)


def plain_background(spark: SparkSession, sf_dir: str) -> CountTable:
    return plain_of(fx.packed(table(spark, sf_dir, "documents"), mode=MODE))


def model(spark: SparkSession, sf_dir: str, **more) -> EvidenceModel:
    return EvidenceModel(site_layer(spark, sf_dir), hash_mode=MODE, **more)


def classified(spark: SparkSession, sf_dir: str, background: Callable[[DataFrame], CountTable | LanguageSet] | None = None, **more) -> DataFrame:
    """Scores of all documents; they are extracted once, for what is learned of them too."""
    docs = corpus(spark, sf_dir)
    m = EvidenceModel(layer_of(docs), hash_mode=MODE, background=background(docs) if background else None, **more)
    return m.classify_packed(docs)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Sums of doubles agree between engines up to their order."""
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


# ---- features


def family_counts(texts: DataFrame, *families: str, params: ExtractParams | None = None) -> DataFrame:
    met = fx.occurrences(texts, params=params).withColumn("family", fx.family(F.col("feature"))).where(F.col("family").isin(*families))
    return met.groupBy("doc_id", "feature").agg(F.count("*").alias("cnt")).groupBy("feature").agg(F.sum("cnt").alias("occurrences"), F.count("*").alias("texts"))


def _documents_family(name: str, family: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return family_counts(table(spark, sf_dir, "documents"), family)

    QUERIES[name] = run


for _name, _family in (("feat_words", "w"), ("feat_bigrams", "w2"), ("feat_numbers", "num"), ("feat_caps", "caps"), ("feat_exclaim", "punct"), ("feat_currency", "sym"), ("feat_mail", "mail")):
    _documents_family(_name, _family)


def _pages_family(name: str, column: str, family: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return family_counts(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col(column).alias("text")), family)

    QUERIES[name] = run


for _name, _column, _family in (("feat_tags", "html", "tag"), ("feat_links", "url", "url"), ("feat_hosts", "url", "host"), ("feat_tlds", "url", "tld"), ("feat_paths", "url", "path"), ("feat_html_hosts", "html", "host")):
    _pages_family(_name, _column, _family)


@query
def feat_char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return family_counts(texts, "c2", "c3", "c4", params=ExtractParams(char_ngrams="all"))


@query
def feat_char_ngrams_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-grams of three characters of all words."""
    params = ExtractParams(char_ngrams="all", min_ngram=3, max_ngram=3)
    return family_counts(table(spark, sf_dir, "documents"), "c3", params=params)


def rewritten(spark: SparkSession, sf_dir: str, text) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query
def feat_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of texts in which some letters are written as character references: the same as of the texts."""
    t = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("e"), F.lit("&#101;")), F.lit("o"), F.lit("&#x6F;"))
    return family_counts(rewritten(spark, sf_dir, t), "w")


@query
def feat_invisible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word pairs of texts with characters that take no room: the same as of the texts."""
    t = F.replace(F.replace("text", F.lit("a"), F.lit("\u200ba\u00ad")), F.lit("t"), F.lit("\u200dt\ufeff"))
    return family_counts(rewritten(spark, sf_dir, t), "w2")


_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in ascii_letters)


@query
def feat_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of texts in full-width letters: the same as of the texts. Mail addresses are not folded, so texts with one stay."""
    t = F.when(F.col("text").contains("@"), F.col("text")).otherwise(F.translate("text", ascii_letters, _WIDE))
    return family_counts(rewritten(spark, sf_dir, t), "w")


#: A letter of a script without spaces for each small Latin one.
HAN = "".join(chr(0x4E00 + k) for k in range(26))


@query
def feat_unspaced_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character n-grams by default: of words that hold a letter of such a script, here in conversations."""
    t = F.translate("text", ascii_lowercase, HAN)
    texts = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), t.alias("text"))
    return family_counts(texts, "c2", "c3", "c4")


@query
def feat_bare_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of addresses without a scheme: the same as of the whole addresses."""
    t = F.concat(F.lit("see "), F.regexp_replace("url", "^https?://", ""))
    return family_counts(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), t.alias("text")), "host")


@query
def feat_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each document's bag; documents without features have 0."""
    docs = table(spark, sf_dir, "documents")
    if not fx.repeats(docs):
        return fx.sizes(docs)
    sizes = fx.bags(docs).groupBy("doc_id").agg(F.count("*").alias("features"), F.sum("cnt").alias("occurrences"), F.max("cnt").alias("most"))
    out = docs.select("doc_id").join(sizes, "doc_id", "left")
    return out.select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("features", "occurrences", "most")])


@query
def feat_family_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = fx.occurrences(table(spark, sf_dir, "documents")).groupBy("feature").agg(F.count("*").alias("cnt"))
    return met.groupBy(fx.family(F.col("feature")).alias("family")).agg(F.count("*").alias("features"), F.sum("cnt").alias("occurrences"))


# ---- hashes and count tables


#: Rows that one task tells hashes apart in, about.
HASH_ROWS = 1 << 22


def by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """h and cnt of all documents, the rows of a hash in one task, and in each task about so many rows, however many there are."""
    bags = fx.packed(table(spark, sf_dir, "documents"), mode=MODE)
    rows = bags.agg(F.coalesce(F.sum(F.size("bag")), F.lit(0))).first()[0]
    return fx.unpacked(bags).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // HASH_ROWS), "h").groupBy("h").agg(F.sum("cnt").alias("cnt"))


@query
def hash_fold_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_hash(spark, sf_dir).groupBy(slot(F.col("h"), SMALL_BITS).alias("slot")).agg(F.count("*").alias("hashes"), F.sum("cnt").alias("cnt"))


@query
def slot_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_slot = by_hash(spark, sf_dir).groupBy(slot(F.col("h"), BITS).alias("slot")).agg(F.count("*").alias("hashes"))
    return per_slot.groupBy("hashes").agg(F.count("*").alias("slots"))


@query
def hash_xxh3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct feature of the documents with its XXH3 hash; each is hashed once."""
    met = fx.occurrences(table(spark, sf_dir, "documents")).groupBy("feature").agg(F.count("*").alias("cnt"))
    return met.withColumn("h", feature_hash(F.col("feature"), "xxh3")).withColumn("slot", slot(F.col("h"), BITS))


@query
def layer_counts_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer_counts(labelled_hashes(spark, sf_dir), BITS)


def _summary(layer: Layer) -> DataFrame:
    c = layer.counts.agg(
        F.count("*").alias("slots"),
        F.coalesce(F.sum("count_ham"), F.lit(0)).alias("total_ham"),
        F.coalesce(F.sum("count_spam"), F.lit(0)).alias("total_spam"),
        F.count(F.when(F.col("count_ham") > 0, 1)).alias("occupied_ham"),
        F.count(F.when(F.col("count_spam") > 0, 1)).alias("occupied_spam"),
    )
    return c.select(F.lit(layer.bits).alias("bits"), F.lit(layer.texts_ham).cast("long").alias("texts_ham"), F.lit(layer.texts_spam).cast("long").alias("texts_spam"), "*")


@query
def layer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(site_layer(spark, sf_dir))


@query
def layer_marginal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_layer(spark, sf_dir).marginal().counts


@query
def layer_halve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_layer(spark, sf_dir, SMALL_BITS).halve().counts


@query
def layer_halve_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(site_layer(spark, sf_dir, SMALL_BITS).halve())


@query
def layer_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = site_layer(spark, sf_dir)
    return site.plus(pretrained_layer(spark, sf_dir)).counts


@query
def layer_unlearn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Take spam out of the ham counts: what is not there stops at 0."""
    rows = counted(labelled(spark, sf_dir).where("label = 'spam'").select("text"))
    return site_layer(spark, sf_dir, SMALL_BITS).unlearn(rows, "ham").counts


# ---- backgrounds and languages


@query
def background_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(spark, sf_dir).tables


@query
def smoothed_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.scoring import smoothed

    t = plain_background(spark, sf_dir)
    return t.counts.select("slot", F.round(F.ln(smoothed(F.col("cnt"), float(t.total), float(t.size), 0.2)), 6).alias("ln_p"))


@query
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir, labels=False)
    return languages_of(docs).detect(fx.unpacked(docs, "doc_id"), docs)


@query
def language_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir, labels=False)
    scores = languages_of(docs).likelihoods(fx.unpacked(docs, "doc_id"))
    return scores.select("doc_id", "lang", F.round("score", 4).alias("score"))


@query
def language_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir, labels=False)
    found = languages_of(docs).detect(fx.unpacked(docs, "doc_id"), docs)
    return docs.select("doc_id", "lang").join(found, "doc_id").groupBy("lang", "language").agg(F.count("*").alias("texts"))


# ---- ratios and scores


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_hashes(spark, sf_dir).select("h").distinct()


@query
def log_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ratios(_vocabulary(spark, sf_dir), site_layer(spark, sf_dir), None, ModelParams()).select("h", "r"), "r")


@query
def log_ratio_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = ratios(_vocabulary(spark, sf_dir), site_layer(spark, sf_dir), None, ModelParams(), plain_background(spark, sf_dir))
    return rounded(rated.select("h", "r"), "r")


@query
def log_ratio_pretrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = ratios(_vocabulary(spark, sf_dir), site_layer(spark, sf_dir), pretrained_layer(spark, sf_dir), ModelParams())
    return rounded(rated.select("h", "r"), "r")


def _scores(df: DataFrame) -> DataFrame:
    return rounded(df.select("doc_id", "log_odds", "occurrences"), "log_odds")


@query
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(classified(spark, sf_dir))


@query
def classify_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(classified(spark, sf_dir, plain_of))


@query
def classify_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(classified(spark, sf_dir, languages_of))


@query
def classify_pretrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(classified(spark, sf_dir, pretrained=pretrained_layer(spark, sf_dir)))


@query
def classify_log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(classified(spark, sf_dir, params=ModelParams(log_counts=True)))


@query
def classify_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each turn; ids name conversation and turn."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "text")
    return _scores(model(spark, sf_dir).classify(turns))


@query
def score_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(classified(spark, sf_dir), "log_odds", "mean_log_odds", "evidence", "probability")


@query
def verdict_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classified(spark, sf_dir)
    return scored.select("doc_id", verdict(F.round("evidence", 6)).alias("verdict"))


@query
def verdict_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = verdict_zones(spark, sf_dir)
    return labelled(spark, sf_dir).select("doc_id", "label").join(zones, "doc_id").groupBy("label", "verdict").agg(F.count("*").alias("texts"))


@query
def explain_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five features of each document that weigh most; equal weights in the order of the features."""
    from pyspark.sql.window import Window as W

    all_ = model(spark, sf_dir).strongest(table(spark, sf_dir, "documents").select("doc_id", "text"), 5)
    all_ = rounded(all_, "log_ratio", "weight", "total")
    order = W.partitionBy("doc_id").orderBy(F.abs("total").desc(), "feature")
    return all_.withColumn("rank", F.row_number().over(order)).where("rank <= 5")


@query
def explain_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions add up to the score."""
    docs = corpus(spark, sf_dir, each=True)
    return rounded(EvidenceModel(layer_of(docs), hash_mode=MODE).explained_sums(docs), "log_odds")


# ---- the store


def new_store(spark: SparkSession, bits: int = BITS) -> CountStore:
    """A store that is gone, with what streams write beside it, when the application ends."""
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    for tail in ("", "-source", "-progress"):
        Folder(spark, f"{path}{tail}").delete_on_exit()
    return CountStore(spark, path).install(bits)


def learned_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, label, sign, archive, bag): each labelled text is learned in the order of ids; right after a text of
    low quality, it is unlearned as the other class, which takes away more than there is."""
    rows = fx.packed(labelled(spark, sf_dir), "doc_id", "label", "quality", mode=MODE)
    learned = rows.select((F.col("doc_id") * 2).alias("seq"), "label", F.lit(1).alias("sign"), "bag")
    other = F.when(F.col("label") == "spam", F.lit("ham")).otherwise(F.lit("spam"))
    wrong = rows.where("quality = 0").select((F.col("doc_id") * 2 + 1).alias("seq"), other.alias("label"), F.lit(-1).alias("sign"), "bag")
    return learned.unionByName(wrong).withColumn("archive", F.lit(False))


def _replayed(spark: SparkSession, sf_dir: str) -> tuple[CountStore, DataFrame]:
    """A store after all steps, and the steps."""
    store, events = new_store(spark), learned_bags(spark, sf_dir)
    store.apply_events(events, 0, events.drop("bag"))
    return store, events


def _again(store: CountStore, events: DataFrame, label: str, texts: int | None = None) -> None:
    """Learn all texts of a class once more."""
    rows = events.where((F.col("sign") == 1) & (F.col("label") == label))
    store.apply(fx.unpacked(rows), label, 1, rows.count() if texts is None else texts)


@query
def store_apply_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir)[0].counts()


@query
def store_clamped_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same steps after all texts were learned as ham."""
    store = new_store(spark)
    events = learned_bags(spark, sf_dir)
    rows = events.where("sign = 1")
    store.apply(fx.unpacked(rows), "ham", 1, rows.count())
    store.apply_events(events, texts=events.drop("bag"))
    return store.counts()


@query
def store_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _replayed(spark, sf_dir)
    store.rotate()
    return store.counts()


@query
def store_rotate_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rotation, the spam again, and another: both generations meet in the archive."""
    store, events = _replayed(spark, sf_dir)
    store.rotate()
    _again(store, events, "spam")
    store.rotate()
    return store.counts()


@query
def store_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, events = _replayed(spark, sf_dir)
    store.rotate()
    _again(store, events, "ham", 1)
    return store.load().counts


@query
def store_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _replayed(spark, sf_dir)
    before = store.tally()
    store.rotate()
    rows = [(t.generation, t.recent_spam, t.recent_ham, t.learned_spam, t.learned_ham, v) for t, v in ((before, store.version() - 1), (store.tally(), store.version()))]
    return spark.createDataFrame(rows, "generation long, recent_spam long, recent_ham long, learned_spam long, learned_ham long, version long")


def _store_model(spark: SparkSession) -> EvidenceModel:
    store = new_store(spark)
    return EvidenceModel(store.load(), store=store, hash_mode=MODE)


@query
def model_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model with a store knows after learning all ham and then all spam."""
    rows, m = labelled(spark, sf_dir), _store_model(spark)
    for label in ("ham", "spam"):
        m, _ = m.learn(rows.where(F.col("label") == label), label)
    return m.site.counts


@query
def store_unlearn_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of low quality are taken back from this generation, the one before, an older one and one to come; the counters then, and what each said."""
    rows, m = labelled(spark, sf_dir), _store_model(spark)
    of = lambda label, weak=False: rows.where(F.col("label") == label).where("quality = 0" if weak else "true")
    m, _ = m.learn(of("ham"), "ham")
    m, _ = m.rotate().learn(of("spam"), "spam")
    m, _ = m.rotate().learn(of("ham"), "ham")
    said = []
    for label, learned_in in (("ham", 2), ("spam", 1), ("ham", 0), ("ham", 3)):
        try:
            m, done = m.unlearn(of(label, weak=True), label, learned_in)
            said.append("taken" if done else "refused")
        except ValueError:
            said.append("error")
    return m.store.counts().withColumn("said", F.lit(",".join(said)))


# ---- catalog and streams

# A manifest and local tables to hold against it.
MANIFEST = {"hash_version": 1, "languages": {"de": {"name": "Deutsch", "sha256": "d1"}, "en": {"name": "English", "sha256": "e1", "sentences": 900}, "fr": {"name": "Français", "sha256": "f2", "sentences": 700}}}
LOCAL = [("en", "e1"), ("fr", "f1"), ("xx", "x1")]


@query
def manifest_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages published, with the documents that a corpus has of each."""
    docs = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("code")).agg(F.count("*").alias("documents"))
    found = catalog.manifest_rows(spark, MANIFEST).join(docs, "code", "left")
    return found.select("code", "name", "sentences", F.coalesce("documents", F.lit(0)).alias("documents"))


@query
def manifest_outdated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.outdated_rows(spark.createDataFrame(LOCAL, "code string, sha256 string"), catalog.manifest_rows(spark, MANIFEST))


@query
def stream_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents, learned as a stream; the store then holds what a batch would give."""
    store = new_store(spark)
    source = f"{store.path}-source"
    labelled(spark, sf_dir).select("doc_id", "text", "label").write.parquet(source)
    texts = spark.readStream.schema("doc_id long, text string, label string").option("maxFilesPerTrigger", 4).parquet(source)
    learn_stream(texts, store, f"{store.path}-progress", mode=MODE).awaitTermination()
    return store.counts()


@query
def stream_learn_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream in which a third of the ids come again, with the same text under the other class, and some rows twice."""
    store = new_store(spark)
    source = f"{store.path}-source"
    rows = labelled(spark, sf_dir).select("doc_id", "text", "label")
    other = rows.where("doc_id % 3 = 0").withColumn("label", F.when(F.col("label") == "spam", F.lit("ham")).otherwise(F.lit("spam")))
    rows.unionByName(other).unionByName(rows.where("doc_id % 3 = 1")).write.parquet(source)
    texts = spark.readStream.schema("doc_id long, text string, label string").option("maxFilesPerTrigger", 4).parquet(source)
    learn_stream(texts, store, f"{store.path}-progress", mode=MODE).awaitTermination()
    t = store.tally()
    return store.counts().withColumn("learned", F.lit(f"{t.learned_ham},{t.learned_spam}"))


def published(spark: SparkSession, sf_dir: str) -> tuple[LanguageSet, str]:
    """The corpus's languages, and a folder with their table files."""
    langs = languages_of(fx.packed(table(spark, sf_dir, "documents"), "lang", mode=MODE), SMALL_BITS)
    folder = f"{shared_folder(spark)}/backgrounds-{uuid.uuid4().hex}"
    background.publish(langs, folder)
    Folder(spark, folder).delete_on_exit()
    return langs, folder


@query
def background_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Background tables written as files, read back and laid out as Parquet by language."""
    _, folder = published(spark, sf_dir)
    background.write_parquet(background.load(spark, folder), f"{folder}/parquet")
    return background.read_parquet(spark, f"{folder}/parquet").tables


@query
def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table files held against the manifest of a release: one was learned further, one is not published."""
    langs, folder = published(spark, sf_dir)
    entries = {r["code"]: {"name": r["code"].upper(), "sha256": r["sha256"]} for r in catalog.local_rows(spark, folder).collect()}
    first, *_, last = sorted(langs.meta)
    grown = langs.select(first)
    Folder(spark, folder).put(f"{first}.bin", encode_background(grown.plus(grown)))
    manifest = {"hash_version": HASH_VERSION, "languages": {k: v for k, v in entries.items() if k != last}}
    return catalog.outdated_rows(catalog.local_rows(spark, folder), catalog.manifest_rows(spark, manifest))


@query
def codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer written in its binary form and read back."""
    return decode_layer(spark, encode_layer(site_layer(spark, sf_dir))).counts


def entry(spark: SparkSession) -> DataFrame:
    """Evidence for every document of the smallest corpus."""
    sf_dir = os.environ.get("TEXTASSAY_ENTRY_DIR", "/root/testdata/sf0.001")
    return model(spark, sf_dir).classify(table(spark, sf_dir, "documents"))

