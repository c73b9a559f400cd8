"""DuckDB oracle SQL, one independent re-derivation per registered query.

The SQL recomputes each result from the base tables (views ``part``,
``lineitem``, ... are registered by the caller) with plain window functions
and aggregates — it shares no code with the Spark plans.
"""

from __future__ import annotations

# --- shared CTE fragments -----------------------------------------------------

IMPRESSIONS = r"""
impressions as (
  select case when p_size = 50 then null
              else lower(c_mktsegment) || ' ' || p_name || ' ' || lower(p_type) end as OriginalQuery,
         case p_partkey % 4 when 0 then 'de' when 1 then 'fr' when 2 then 'it' else 'en' end as PageLanguage,
         p_partkey as product_id,
         p_name as ProductName,
         case when p_brand = 'Brand#13' then null else p_brand end as BrandName,
         case when p_size % 7 = 0 then null else 'Group ' || cast(p_size as varchar(10)) end as Level4_ProductGroup,
         case when p_size % 11 = 0 then null else p_type end as ProductType,
         cast(sum(case when l_returnflag = 'A' and l_discount > 0.055 then 1 else 0 end) as bigint) as UniqueSelects
  from lineitem join part on l_partkey = p_partkey
                join orders on l_orderkey = o_orderkey
                join customer on o_custkey = c_custkey
  group by 1, 2, 3, 4, 5, 6, 7
)"""

STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x=x)


JUDGED = (
    IMPRESSIONS
    + r""",
judged as (
  select OriginalQuery, PageLanguage,
         """
    + strip(
        "coalesce(ProductName,'') || ' ' || coalesce(BrandName,'') || ' ' || "
        "coalesce(Level4_ProductGroup,'') || ' ' || coalesce(ProductType,'')"
    )
    + r""" as product_text,
         cast(case when UniqueSelects > 0 then 1 else 0 end as integer) as relevant,
         product_id
  from impressions where OriginalQuery is not null
)"""
)

UKEY = "coalesce(ProductName,'') || ' / ' || coalesce(BrandName,'') || ' / ' || coalesce(ProductType,'')"

CATALOG = (
    JUDGED
    + r""",
catalog as (
  select ProductName, BrandName, ProductType, Level4_ProductGroup, PageLanguage, unique_key,
         """
    + strip(
        "coalesce(ProductName,'') || ' ' || coalesce(BrandName,'') || ' ' || "
        "coalesce(ProductType,'') || ' ' || coalesce(Level4_ProductGroup,'')"
    )
    + r""" as product_text,
         product_id
  from (select *, """
    + UKEY
    + """ as unique_key,
               row_number() over (partition by """
    + UKEY
    + r""" order by product_id) as rn_
        from impressions) u
  where rn_ = 1
)"""
)

JUDGED_VEC = r"""
judged_vec as (
  select q.vec_id as query_id, c.vec_id as product_id,
         list_dot_product(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) as score,
         cast(case when q.label = c.label then 1 else 0 end as integer) as relevant
  from embeddings q join embeddings c
    on q.vec_id % 10 = 0 and c.vec_id % 10 <> 0 and (c.vec_id * 7 + q.vec_id * 13) % 23 = 0
)"""

JUDGED_VEC_GRADED = r"""
judged_vec as (
  select q.vec_id as query_id, c.vec_id as product_id,
         list_dot_product(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) as score,
         cast(case when q.label = c.label then 2 when abs(q.label - c.label) = 1 then 1 else 0 end as integer) as relevant
  from embeddings q join embeddings c
    on q.vec_id % 10 = 0 and c.vec_id % 10 <> 0 and (c.vec_id * 7 + q.vec_id * 13) % 23 = 0
)"""


def ranked(src: str, q: str, key: str, score: str = "score", name: str = "ranked") -> str:
    return f"""
{name} as (
  select *, row_number() over (partition by {q}
         order by ({score} is null or isnan({score})), {score} desc, {key}) as rk
  from {src}
)"""


def metric_stats(src_ranked: str, q: str, ks=(1, 5, 10), gain: str = "linear", rel: str = "relevant", p: str = "") -> str:
    """CTE ``stats``: per query counts, first positive rank, DCG/IDCG per k."""
    g = (lambda r: f"cast({r} as double)") if gain == "linear" else (lambda r: f"(pow(2.0, {r}) - 1.0)")
    ideal_ctes = []
    ideal_joins = []
    ideal_cols = []
    for k in ks:
        ideal_ctes.append(
            f"""
{p}ideal{k} as (
  select {q}, sum({g(rel)} / log2(irk + 1)) as idcg
  from (select {q}, {rel}, row_number() over (partition by {q} order by {rel} desc) as irk
        from {src_ranked} where rk <= {k}) t
  group by {q}
)"""
        )
        ideal_joins.append(f"left join {p}ideal{k} on {p}ideal{k}.{q} = {p}base.{q}")
        ideal_cols.append(f"{p}ideal{k}.idcg as idcg{k}")
    dcg_cols = ",\n         ".join(
        f"sum(case when rk <= {k} then {g(rel)} / log2(rk + 1) else 0.0 end) as dcg{k}" for k in ks
    )
    return (
        ",".join(ideal_ctes)
        + f""",
{p}base as (
  select {q}, cast(count(*) as bigint) as num_products, cast(sum({rel}) as bigint) as num_positives,
         min(case when {rel} = 1 then rk end) as first_pos,
         {dcg_cols}
  from {src_ranked} group by {q}
),
{p}stats as (
  select {p}base.*, {", ".join(ideal_cols)}
  from {p}base {" ".join(ideal_joins)}
)"""
    )


def metric_select(ks=(1, 5, 10)) -> list[str]:
    cols = []
    for k in ks:
        cols.append(f"cast(case when first_pos <= {k} then 1 else 0 end as integer) as \"hit@{k}\"")
    for k in ks:
        cols.append(f"case when first_pos <= {k} then 1.0 / first_pos else 0.0 end as \"mrr@{k}\"")
    for k in ks:
        cols.append(f"case when idcg{k} > 0 then dcg{k} / idcg{k} else 0.0 end as \"ndcg@{k}\"")
    return cols


def summary_sql(ks=(1, 5, 10), digits: int = 6) -> str:
    """Select over CTE ``pq`` (per-query metrics of all queries)."""
    names = [f"hit@{k}" for k in ks] + [f"mrr@{k}" for k in ks] + [f"ndcg@{k}" for k in ks]
    means = ",\n  ".join(
        f'round(avg(case when num_positives > 0 then cast("{m}" as double) end), {digits}) as "{m}"' for m in names
    )
    return f"""
select cast(count(*) as bigint) as num_queries_total,
  cast(count(*) filter (where num_positives > 0) as bigint) as num_queries_with_positive,
  round(avg(num_products), {digits}) as avg_products_per_query,
  cast(count(*) filter (where num_positives > 0) as bigint) as queries_evaluated,
  {means}
from pq"""


def per_query_cte(src: str, q: str, key: str, ks=(1, 5, 10), gain: str = "linear", p: str = "") -> str:
    """CTEs ``<p>ranked``, ``<p>stats`` and ``<p>pq`` over candidate table ``src``."""
    return (
        ranked(src, q, key, name=f"{p}ranked")
        + ","
        + metric_stats(f"{p}ranked", q, ks, gain, p=p)
        + f""",
{p}pq as (
  select {q}, num_products, num_positives, first_pos, {", ".join(metric_select(ks))}
  from {p}stats
)"""
    )


# --- query split (seeded md5 order) ------------------------------------------------

SPLITS = (
    JUDGED
    + r""",
qsplit as (
  select OriginalQuery, rn, n,
         case when rn <= floor(n * 0.8::DOUBLE) then 'train'
              when rn <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) then 'val'
              else 'test' end as split
  from (select OriginalQuery,
               row_number() over (order by md5('42:' || OriginalQuery), OriginalQuery) as rn,
               cast(count(*) over () as double) as n
        from (select distinct OriginalQuery from judged) d) r
),
judged_split as (select j.*, s.split from judged j join qsplit s on s.OriginalQuery = j.OriginalQuery)"""
)


# --- hashing encoder -----------------------------------------------------------------


def hash_vectors(name: str, src_sql: str, dim: int = 64) -> str:
    """CTEs ``<name>`` (text, b, c) sparse counts and ``<name>_sq`` (text, sq)
    for the distinct non-null ``text`` values of ``src_sql``."""
    return rf"""
{name}_t as (select distinct text from ({src_sql}) s where text is not null),
{name}_tok as (select text, unnest(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+')) as t from {name}_t),
{name} as (select text, cast(('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} as integer) as b, count(*) as c
           from {name}_tok where t <> '' group by text, b),
{name}_sq as (select x.text, coalesce(sum(v.c * v.c), 0) as sq
              from {name}_t x left join {name} v on v.text = x.text group by x.text)"""


def cosine_scores(name: str, pairs: str, qv: str, pv: str) -> str:
    """CTE ``<name>``: every row of ``pairs`` (which has text columns qt, pt) plus
    ``score`` = dot / (sqrt(|q|^2) * sqrt(|p|^2)), 0 for a zero vector."""
    return rf"""
{name}_dot as (
  select x.qt, x.pt, sum(a.c * b.c) as d
  from (select distinct qt, pt from {pairs}) x
  join {qv} a on a.text = x.qt
  join {pv} b on b.text = x.pt and a.b = b.b
  group by x.qt, x.pt
),
{name} as (
  select p.*, case when sqrt(qs.sq) * sqrt(ps.sq) > 0
                   then cast(coalesce(dd.d, 0) as double) / (sqrt(qs.sq) * sqrt(ps.sq)) else 0.0 end as score
  from {pairs} p
  join {qv}_sq qs on qs.text = p.qt
  join {pv}_sq ps on ps.text = p.pt
  left join {name}_dot dd on dd.qt = p.qt and dd.pt = p.pt
)"""


def text_scored(src: str = "judged", dim: int = 64, name: str = "scored") -> str:
    """CTEs scoring every row of ``src`` (OriginalQuery, product_text) with the
    hashing encoder; result CTE ``<name>`` has all columns of src + qt, pt, score."""
    return (
        f"""
{name}_pairs as (select *, 'query: ' || OriginalQuery as qt, 'passage: ' || product_text as pt from {src}),"""
        + hash_vectors(f"{name}_qv", f"select qt as text from {name}_pairs", dim)
        + ","
        + hash_vectors(f"{name}_pv", f"select pt as text from {name}_pairs", dim)
        + ","
        + cosine_scores(name, f"{name}_pairs", f"{name}_qv", f"{name}_pv")
    )


def catalog_search(k: int, dim: int = 64, catalog: str = "catalog", name: str = "hits") -> str:
    """CTE ``<name>`` (query, product_id, score, rk) — every distinct judged query
    against every product of ``catalog``, top k by score desc then product_id."""
    return (
        f"""
{name}_q as (select distinct OriginalQuery as query, 'query: ' || OriginalQuery as qt from judged),
{name}_c as (select *, 'passage: ' || product_text as pt from {catalog}),
{name}_pairs as (select q.query, q.qt, c.product_id, c.pt from {name}_q q cross join {name}_c c),"""
        + hash_vectors(f"{name}_qv", f"select qt as text from {name}_q", dim)
        + ","
        + hash_vectors(f"{name}_pv", f"select pt as text from {name}_c", dim)
        + ","
        + cosine_scores(f"{name}_s", f"{name}_pairs", f"{name}_qv", f"{name}_pv")
        + f""",
{name} as (
  select query, product_id, score, rk from (
    select query, product_id, score,
           row_number() over (partition by query order by (score is null or isnan(score)), score desc, product_id) as rk
    from {name}_s) t
  where rk <= {k}
)"""
    )


# Stand-alone tails, so a query can combine fragments without repeating CTEs.
CATALOG_PART = CATALOG[len(JUDGED):]  # starts with ",\ncatalog as (...)"
SPLITS_PART = SPLITS[len(JUDGED):]  # ",\nqsplit ..., judged_split ..."


def with_(*parts: str) -> str:
    return "with " + "".join(parts)
