"""Mixing sources to target weights by hierarchical budgets.

Sources stand in a tree: domain, language, source.  A token budget is dealt out from the root by the children's
weights; a child that can't take its share (its documents, read at most ``epochs`` times, hold too few tokens) takes
all it has, and what it leaves is dealt among its siblings by their weights; only what a whole subtree can't take goes
to the siblings of its parent.  Each source is then read in seeded orders, one per epoch, up to its budget.

Everything is DataFrame functions.  Order within a source comes from ranges of hashes: token sums per range are
cumulated first, so no task ever sees more than one range of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.session import checkpointed, semi_by_size

LEVELS = ["domain", "lang", "source"]
#: Documents of a source that share one hash range, on average.
RANGE_DOCS = 1024
#: Leaves (sources of one language and domain, about 100 bytes each) that may be broadcast.
BROADCAST_LEAVES = 200_000
EPOCHS = 2
SHARE = 0.5
SEED = "mix-1"
#: Default weights by name; names that aren't listed weigh DEFAULT_WEIGHT.
DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}
LANGUAGE_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
DEFAULT_WEIGHT = 1


def default_domain() -> Column:
    """One of four domains for each source name."""
    return F.concat(F.lit("domain"), F.pmod(F.crc32(F.coalesce(F.col("source").cast("string"), F.lit("")).cast("binary")), F.lit(4)).cast("string"))


def _weights(level: Column, given: dict[str, int] | None) -> Column:
    if not given:
        return F.lit(DEFAULT_WEIGHT).cast("long")
    table = F.create_map(*[F.lit(x) for k, w in given.items() for x in (k, int(w))])
    return F.coalesce(F.element_at(table, level), F.lit(DEFAULT_WEIGHT)).cast("long")


def _filled(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Deals each parent's ``budget`` among its children by ``weight``, none above its ``capacity``.

    Children are taken in order of capacity per weight.  As long as a child's fair share of what is left is more than
    its capacity it is full; from the first that isn't, all take shares of what the full ones left.  Whole tokens,
    rounded down.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("capacity") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumns(
        {
            "_taken": F.coalesce(F.sum("capacity").over(before), F.lit(0)),
            "_light": F.coalesce(F.sum("weight").over(before), F.lit(0)),
            "_all": F.sum("weight").over(by),
        }
    )
    left, heavy = F.col("budget") - F.col("_taken"), F.col("_all") - F.col("_light")
    exact = lambda c: c.cast("decimal(38,0)")
    nodes = nodes.withColumn("_open", exact(left) * exact(F.col("weight")) < exact(F.col("capacity")) * exact(heavy))
    # The level of the first open child, whose rest is the largest, holds for all open ones.
    first = lambda c: F.max(F.when(F.col("_open"), c)).over(by)
    nodes = nodes.withColumns({"_left": first(left), "_heavy": first(heavy)})
    exactly = F.expr("cast(cast(_left as decimal(19,0)) * cast(weight as decimal(19,0)) div cast(_heavy as decimal(19,0)) as bigint)")
    return nodes.withColumn("budget", F.when(F.col("_open"), exactly).otherwise(F.col("capacity"))).drop("_taken", "_light", "_all", "_open", "_left", "_heavy")


def budgets(leaves: DataFrame, total: Column, domain_weights=None, language_weights=None, source_weights=None, epochs: int = EPOCHS) -> DataFrame:
    """``domain, lang, source, tokens, docs, budget`` for ``leaves(domain, lang, source, tokens, docs)``.

    ``total``: a column of the tokens to deal out, for which ``all_tokens`` is in scope.
    """
    leaves = leaves.withColumn("capacity", F.col("tokens") * F.lit(epochs))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    domains = leaves.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("own_tokens"))
    every = Window.partitionBy(F.lit(0))
    domains = domains.withColumn("all_tokens", F.sum("own_tokens").over(every)).withColumn("budget", total.cast("long"))
    domains = _filled(domains.withColumn("weight", _weights(F.col("domain"), domain_weights)), [], "domain")
    langs = langs.join(domains.select("domain", "budget"), "domain")
    langs = _filled(langs.withColumn("weight", _weights(F.col("lang"), language_weights)), ["domain"], "lang")
    sources = leaves.join(langs.select("domain", "lang", "budget"), ["domain", "lang"])
    sources = _filled(sources.withColumn("weight", _weights(F.col("source"), source_weights)), ["domain", "lang"], "source")
    return sources.select(*LEVELS, "tokens", "docs", "budget")


def n_tokens(text: Column) -> Column:
    """Runs of characters other than white space (space, tab to carriage return)."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(doc_id: Column, epoch: Column, seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), doc_id.cast("string")).cast("binary"))


def mixed(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, domain: Column | None = None, domain_weights=DOMAIN_WEIGHTS, language_weights=LANGUAGE_WEIGHTS, source_weights=None, columns: list[str] | None = None) -> DataFrame:
    """The chosen documents: ``columns`` of ``docs`` (all, unless given), ``domain, n_tokens, epoch`` (from 1).

    The budget is ``share`` of all tokens, rounded down.  A source's budget is filled epoch by epoch; each epoch reads
    its documents in the order of ``md5(seed|epoch|doc_id)``, and the last one stops before the document whose end
    would pass the budget.

    - Null and empty texts have no tokens: they come along with whole epochs and up to where an epoch's budget ends.
    - Null languages and sources are names of their own (empty); a null doc_id is ordered as empty.
    - Rows that share a doc_id are read one by one, in the order of a hash of their columns; equal rows are as good as each other.
    - No rows, or no tokens, give no rows.  Columns with the new names are replaced.
    """
    named = docs.drop("domain", "n_tokens", "epoch") if columns is None else docs
    keep = [c for c in named.columns] if columns is None else columns
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    hashed = [F.col(f"`{f.name}`") for f in named.schema if "map<" not in f.dataType.simpleString()]
    # Whole rows are one column, so that their names can't clash with those used here.
    own = {"_row": F.struct(*[F.col(f"`{c}`") for c in keep]), "_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_tie": F.xxhash64(*hashed)}
    own |= {"_domain": default_domain() if domain is None else domain, "_lang": name("lang"), "_source": name("source"), "_n": n_tokens(F.col("text"))}
    rows = named.select(*[c.alias(k) for k, c in own.items()])
    leaf = ["_domain", "_lang", "_source"]
    leaves = checkpointed(rows.groupBy(*leaf).agg(F.sum("_n").alias("tokens"), F.count("*").alias("docs")).toDF(*LEVELS, "tokens", "docs"))
    plan = checkpointed(budgets(leaves, F.floor(F.lit(share) * F.col("all_tokens")), domain_weights, language_weights, source_weights, epochs).where("tokens > 0").toDF(*leaf, "_tokens", "_docs", "_budget"))
    plan = checkpointed(plan).withColumns({"_whole": F.expr("_budget div _tokens"), "_part": F.expr("_budget % _tokens"), "_ranges": F.ceil(F.col("_docs") / RANGE_DOCS).cast("long")})
    placed = semi_by_size(rows, plan, leaf, "inner", BROADCAST_LEAVES)
    # Epochs read as a whole, and the one that is read in part.
    epochs_of = F.sequence(F.lit(1), F.col("_whole").cast("int") + F.when(F.col("_part") > 0, 1).otherwise(0))
    placed = placed.where("_budget > 0").withColumn("epoch", F.explode(epochs_of))
    placed = placed.withColumn("_key", order_key(F.col("_id"), F.col("epoch"), seed)).withColumn("_range", F.expr("cast(conv(substr(_key, 1, 8), 16, 10) as bigint) * _ranges div 4294967296"))
    whole = placed.where("epoch <= _whole")
    part = placed.where("epoch > _whole")
    sums = part.groupBy(*leaf, "_range").agg(F.sum("_n").alias("_in_range"))
    ahead = F.sum("_in_range").over(Window.partitionBy(*leaf).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starts = sums.withColumn("_ahead", ahead - F.col("_in_range")).drop("_in_range")
    own = Window.partitionBy(*leaf, "_range").orderBy("_key", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = part.join(starts, [*leaf, "_range"]).where("_ahead <= _part").withColumn("_end", F.col("_ahead") + F.sum("_n").over(own)).where("_end <= _part")
    out = whole.select("_row", "_domain", "_n", "epoch").union(part.select("_row", "_domain", "_n", "epoch"))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in keep], F.col("_domain").alias("domain"), F.col("_n").alias("n_tokens"), "epoch")
