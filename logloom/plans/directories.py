"""Registered queries of directory trees, with their DuckDB SQL: what their regions show, and how a search is routed through them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, evidence_terms
from ..operators import choice, directory, ranks, spans
from . import adapters as A
from .catalogue import query
from .evidence import SIGNALS

#: Documents of a segment, children of a node, bytes of an excerpt, and what the answer "unknown" scores.
SEGMENT, FANOUT, EXCERPT, UNKNOWN = 2, 6, 120, 1.0
CASE = ["source"]


def _items(spark, d) -> DataFrame:
    """A source is a case and its documents, by id, are the steps: source, doc_id, idx, seg, n (segments), signals, hits, overlap, content."""
    docs = A.load(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", F.coalesce("text", F.lit("")).alias("content"))
    placed = ranks.grouped_rank(docs.select("source", "doc_id").withColumn("one", F.lit(1)), CASE, "one", "doc_id", "rank").select("doc_id", "source", (F.col("rank") - 1).alias("idx"))
    counts = placed.groupBy("source").agg(F.count("*").alias("n_items"))
    asked = docs.groupBy("source").agg(F.min_by("content", "doc_id").alias("first"), F.max_by("content", "doc_id").alias("last"))
    asked = asked.select("source", evidence_terms(F.concat_ws(" ", "first", "last")).alias("asked"))
    shown = choice.signals(F.col("content"), SIGNALS)
    overlap = F.size(F.array_intersect(evidence_terms(F.col("content")), F.col("asked"))).cast("long")
    met = docs.join(asked, "source").select("source", "doc_id", "content", overlap.alias("overlap"), *[c.alias(k) for k, c in shown.items()])
    hits = sum((F.col(k).cast("long") for k in SIGNALS), F.lit(0).cast("long"))
    whole = met.join(placed, ["source", "doc_id"]).join(counts, "source")
    return whole.select("source", "doc_id", "idx", F.floor(F.col("idx") / SEGMENT).alias("seg"), F.ceil(F.col("n_items") / SEGMENT).alias("n"), "n_items", *SIGNALS, hits.alias("hits"), "overlap", "content")


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_T = rf"list_filter(list_distinct(regexp_extract_all(lower({{0}}), '[\p{{{{L}}}}\p{{{{N}}}}\p{{{{M}}}}_./:-]{{{{3,}}}}')), lambda x: x not in ({_STOP}))".replace("{{", "{").replace("}}", "}")
_terms = lambda x: _T.replace("{0}", x)
_FLAGS = ", ".join(f"regexp_matches(content, '{p}', 'i') as {k}" for k, p in SIGNALS.items())
_TREE = f"""with recursive docs as (select coalesce(source, '') as source, doc_id, coalesce(text, '') as content from documents),
q as (select source, {_terms("arg_min(content, doc_id) || ' ' || arg_max(content, doc_id)")} as asked from docs group by 1),
i as (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as idx, count(*) over (partition by source) as n_items, {_FLAGS},
  len(list_intersect({_terms("content")}, asked)) as overlap, content from docs join q using (source)),
items as (select *, idx // {SEGMENT} as seg, failure::int + repair::int + constraint_::int as hits from (select * exclude ("constraint"), "constraint" as constraint_ from i)),
t as (select source, 0::bigint as s, ceil(n_items / {SEGMENT}.0)::bigint as e, 0 as depth, null::bigint as ps, null::bigint as pe from (select distinct source, n_items from items)
  union all select source, x, least(x + w, e), depth + 1, s, e from (select *, unnest(range(s, e, w)) as x from (select *, ceil((e - s) / {FANOUT}.0)::bigint as w from t where e - s > 1))),
pv as (select t.source, s, e, depth, ps, pe, count(*) as n_refs, min(idx) as lo, min(doc_id) as first_step, max(doc_id) as last_step, min({{'h': -hits, 'o': -overlap, 'd': doc_id}}) as best,
  bool_or(failure) as failure, bool_or(repair) as repair, bool_or(constraint_) as constraint_ from t join items on items.source = t.source and seg >= s and seg < e group by all)"""


def _region_views(items: DataFrame) -> DataFrame:
    return directory.rolled_up(items, "source", "seg", "n", "idx", "doc_id", "doc_id", "hits", "overlap", list(SIGNALS), FANOUT)


def _clip(c: str, x: str) -> str:
    text = f"substr({x}, {c} + 1)"
    return f"left({text}, coalesce(list_max(list_filter(range(0, {EXCERPT} + 1), lambda k: strlen(left({text}, k)) <= {EXCERPT})), 0)::bigint)"


_AT = "greatest(case " + " ".join(f"when regexp_matches(lower({{x}}), '{p}') then strpos(lower({{x}}), regexp_extract(lower({{x}}), '{p}')) - 1" for p in SIGNALS.values()) + " else 0 end - 50, 0)::bigint"


@query(f"""{_TREE}, m as (select pv.*, b.content as bt, c.content as mt, c.doc_id as middle from pv join items b on b.source = pv.source and b.doc_id = pv.best.d join items c on c.source = pv.source and c.idx = lo + n_refs // 2),
a as (select *, {_AT.format(x="bt")} as bc, {_AT.format(x="mt")} as mc from m)
select source, s as start_seg, e as end_seg, n_refs, first_step, last_step, concat_ws(',', case when failure then 'failure' end, case when repair then 'repair' end, case when constraint_ then 'constraint' end) as tags,
  best.d as best, -best.h as hits, -best.o as overlap, strlen(left(bt, bc))::bigint as best_byte, sha256({_clip('bc', 'bt')}) as best_sha256,
  case when middle <> best.d then middle end as middle, case when middle <> best.d then strlen(left(mt, mc))::bigint end as middle_byte, case when middle <> best.d then sha256({_clip('mc', 'mt')}) end as middle_sha256 from a""")
def tree_preview(spark, d):
    """Every region of every tree: its range, its signals, and excerpts of its best and its middle document."""
    items = _items(spark, d)
    views = _region_views(items)
    first, _, content = spans.excerpt_at(F.col("content"), spans.signal_start(F.col("content"), list(SIGNALS.values())), EXCERPT)
    cards = items.select("source", "idx", "doc_id", first.cast("long").alias("byte"), F.sha2(content, 256).alias("sha256"))
    best = cards.select("source", F.col("idx").alias("best_idx"), F.col("byte").alias("best_byte"), F.col("sha256").alias("best_sha256"))
    middle = cards.select("source", F.col("idx").alias("middle_idx"), F.col("doc_id").alias("__middle"), F.col("byte").alias("__byte"), F.col("sha256").alias("__sha256"))
    met = views.withColumn("best_idx", F.col("best.idx")).join(best, ["source", "best_idx"]).join(middle, ["source", "middle_idx"])
    other = F.col("middle_idx") != F.col("best_idx")
    tags = F.concat_ws(",", *[F.when(F.col(k), F.lit(k)) for k in SIGNALS])
    return met.select(
        "source", F.col("s").alias("start_seg"), F.col("e").alias("end_seg"), "n_refs", "first_step", "last_step", tags.alias("tags"), F.col("best.ref").alias("best"), "best.hits", "best.overlap",
        "best_byte", "best_sha256", *[F.when(other, F.col(f"__{k}")).alias(k if k == "middle" else f"middle_{k}") for k in ("middle", "byte", "sha256")],
    )


_ROUTE = f"""{_TREE}, sc as (select source, s, e, ps, pe, 'range_' || s || '_' || e as name, -best.h - best.o / 8.0::double as score from pv where ps is not null),
o as (select source, ps, pe, name, s, e, score from sc union all select distinct source, ps, pe, 'unknown', null, null, {UNKNOWN}::double from sc),
p as (select *, round(exp(score - mx) / sum(exp(score - mx)) over (partition by source, ps, pe), 9) as p from (select *, max(score) over (partition by source, ps, pe) as mx from o)),
placed as (select *, row_number() over (partition by source, ps, pe order by p desc, name) as place, count(*) over (partition by source, ps, pe) as family from p where s is not null),
walk as (select source, s, e, []::bigint[] as path, 0::bigint as pending from t where ps is null
  union all select c.source, c.s, c.e, list_append(w.path, c.place), w.pending + c.family - c.place from walk w join placed c on c.source = w.source and c.ps = w.s and c.pe = w.e),
ordered as (select *, sum((e - s > 1)::int) over (partition by source order by path rows between unbounded preceding and current row)::bigint as routed,
  sum((e - s = 1)::int) over (partition by source order by path rows between unbounded preceding and current row)::bigint - 1 as visit from walk),
leaves as (select source, s as segment, visit, routed, pending from ordered where e - s = 1)"""


def _branches(views: DataFrame) -> DataFrame:
    """(source, s, e, p) of every region but the roots: the answers to which child of a node should be read next."""
    whole = views.groupBy("source").agg(F.max("e").alias("n"))
    tree = views.join(whole, "source").withColumn("path", directory.chain(F.col("s"), F.col("n"), FANOUT))
    depth = F.array_position(F.col("path"), F.struct("s", "e")).cast("int")
    child = tree.withColumn("depth", depth).where("depth > 1").withColumn("parent", F.get("path", F.col("depth") - 2))
    score = F.col("best.hits") + F.col("best.overlap") / F.lit(8.0)
    options = child.select("source", "parent", "s", "e", directory.region(F.col("s"), F.col("e")).alias("name"), score.alias("score"))
    unsure = options.select("source", "parent").distinct().select("*", F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("e"), F.lit("unknown").alias("name"), F.lit(UNKNOWN).alias("score"))
    return choice.distribution(options.unionByName(unsure), ["source", "parent"], "name", "score").where("s is not null").select("source", "s", "e", "p")


def _visits(items: DataFrame) -> DataFrame:
    sizes = items.groupBy("source", F.col("seg").alias("segment")).agg(F.count("*").alias("n_items"), F.max("n").alias("n"))
    tree = directory.nodes(sizes, "source", "segment", "n", FANOUT)
    return directory.visits(tree, _branches(_region_views(items)), "source", sizes.select("source", "segment", "n_items"))


@query(_ROUTE + " select * from leaves")
def directory_route(spark, d):
    """The order in which a depth-first search reads the segments, what it has asked by then and what still waits."""
    return _visits(_items(spark, d)).select("source", "segment", "visit", "routed", "pending")


_SCORE = "2.0::double * failure::int + constraint_::int - repair::int + overlap / 8.0::double"


@query(f"""{_ROUTE}, l as (select source, seg, doc_id, {_SCORE} as score from items),
lp as (select *, round(exp(score - mx) / (sum(exp(score - mx)) over (partition by source, seg) + exp({UNKNOWN} - mx)), 9) as p from (select *, greatest(max(score) over (partition by source, seg), {UNKNOWN}) as mx from l)),
r as (select *, row_number() over (partition by source, seg order by p desc, doc_id) - 1 as place from lp),
j as (select r.*, visit from r join leaves on leaves.source = r.source and leaves.segment = r.seg)
select source, doc_id, seg as segment, row_number() over (partition by source order by place > 0, case when place = 0 then visit else -visit end, place) - 1 as attempt from j""")
def directory_candidates(spark, d):
    """When the search takes up each document as a candidate: the best lead of every segment that it reads, the others after them."""
    items = _items(spark, d)
    score = choice.suspicion({k: F.col(k) for k in SIGNALS}, F.col("overlap"))
    options = items.select("source", F.col("seg").alias("segment"), F.col("doc_id"), F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("name"), score.alias("score"))
    unsure = options.select("source", "segment").distinct().select("*", F.lit(None).cast("long").alias("doc_id"), F.lit("unknown").alias("name"), F.lit(UNKNOWN).alias("score"))
    told = choice.distribution(options.unionByName(unsure), ["source", "segment"], "name", "score").where("doc_id is not null")
    own = Window.partitionBy("source", "segment")
    leads = told.select("source", "segment", "doc_id", (F.row_number().over(own.orderBy(F.desc("p"), "doc_id")) - 1).alias("place"), F.count("*").over(own).alias("n_here"))
    totals = items.groupBy("source").agg(F.max("n").alias("n_segments"), F.count("*").alias("n_items"))
    return directory.attempts(leads, _visits(items), totals, "source").select("source", "doc_id", "segment", "attempt")

