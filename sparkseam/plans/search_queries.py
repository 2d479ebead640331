"""Retrieval and store queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkseam.functions.text import terms
from sparkseam.operators import search, store, vector_index
from sparkseam.operators.keyed_table import KeyedTable
from sparkseam.operators.keyword_index import KeywordIndex
from sparkseam.plans.fixtures import frame
from sparkseam.session import folder, read_table

QUERY = ["the", "tion", "thand", "of", "erer", "the"]
QUERY_TEXT = "the tion thand of erer the"
K = 10
TERMS_SQL = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-zA-Z0-9./]+'), lambda x: length(x) >= 2)"


def vector0(spark, sf):
    row = read_table(spark, sf, "embeddings").filter("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]] if row else [0.0] * 64


Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


_COS = "list_inner_product(e.embedding::double[], q.embedding::double[]) / greatest(sqrt(list_inner_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_inner_product(q.embedding::double[], q.embedding::double[])), 1e-10)"
_VEC = f"select e.vec_id, e.label, round({_COS}, 6) as score from embeddings e, (select embedding from embeddings where vec_id = 0) q"
_BM = f"""
d as (select doc_id as id, lang, {TERMS_SQL} as t from documents),
st as (select count(*) as n, avg(len(t)) as avgdl from d),
q as (select unnest(['the','tion','thand','of','erer']) as term, unnest([2,1,1,1,1]) as qtf),
h as (select id, dl, term, count(*) as tf from (select id, len(t) as dl, unnest(t) as term from d) where term in (select term from q) group by all),
f as (select term, count(*) as df from h group by term),
raw as (select id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as raw from h join f using (term) join q using (term), st group by id),
sp as (select max(raw) as hi, case when count(*) < (select n from st) then 0 else min(raw) end as lo from raw),
bm as (select id, raw, round(case when hi = lo then (raw > 0)::int else (raw - lo) / (hi - lo) end, 6) as score from raw, sp)"""


@query("tokenize_terms", f"select doc_id, len({TERMS_SQL})::int as n_terms, array_to_string({TERMS_SQL}, ' ') as terms from documents")
def tokenize_terms(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", F.size(terms(F.col("text"))).alias("n_terms"), F.array_join(terms(F.col("text")),
        " ").alias("terms"))


@query("idf_table", f"with d as (select distinct doc_id, unnest({TERMS_SQL}) as term from documents) select term, count(*) as df, round(ln(((select "
    f"count(*) from documents) + 1) / (count(*) + 1)) + 1, 6) as idf from d group by term")
def idf_table(spark, sf):
    docs = read_table(spark, sf, "documents")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = docs.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1, 6).alias("idf"))


@query("keyword_bm25_topk", f"with {_BM} select id as doc_id, score, row_number() over (order by score desc, id)::int as rank from bm where score > 0 "
    f"order by score desc, id limit {K}")
def keyword_bm25_topk(spark, sf):
    rows = search.bm25(read_table(spark, sf, "documents"), QUERY, "doc_id", "text").withColumn("score", F.round("score", 6)).filter("score > 0")
    return search.ranked(rows, "score", K, "id").select(F.col("id").alias("doc_id"), "score", "rank")


@query("keyword_index_topk", f"with {_BM} select id as doc_id, score, row_number() over (order by score desc, id)::int as rank from bm where score > "
    f"0 order by score desc, id limit {K}")
def keyword_index_topk(spark, sf):
    """The same from a stored index that was built of half the documents, then extended, shrunk and extended again."""
    docs, index = read_table(spark, sf, "documents"), KeywordIndex(spark, folder(spark, "keywords"))
    index.add(docs.filter("lang = 'en'"), "doc_id", "text")
    index.add(docs.filter("lang <> 'en'"), "doc_id", "text")
    index.remove(docs.filter("lang = 'fr'"), "doc_id")
    index.add(docs.filter("lang = 'fr'"), "doc_id", "text")
    rows = index.bm25_topk(QUERY, K).withColumn("score", F.round("score", 6)).filter("score > 0")
    return search.ranked(rows, "score", K, "id").select(F.col("id").alias("doc_id"), "score", "rank")


@query("keyword_index_follow", SQL["keyword_bm25_topk"])
def keyword_index_follow(spark, sf):
    """An index of other texts under some ids, without some documents and with some that are gone by now, brought to the documents."""
    docs, index = read_table(spark, sf, "documents").select("doc_id", "text"), KeywordIndex(spark, folder(spark, "keywords"))
    was = docs.filter("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" the of erer"))).otherwise(F.col("text")))
    was = was.unionByName(docs.filter("doc_id % 13 = 0").withColumn("doc_id", -1 - F.col("doc_id")))
    index.sync(was, "doc_id", "text")
    index.sync(docs, "doc_id", "text")
    rows = index.bm25_topk(QUERY, K).withColumn("score", F.round("score", 6)).filter("score > 0")
    return search.ranked(rows, "score", K, "id").select(F.col("id").alias("doc_id"), "score", "rank")


@query("keyword_index_sync", "select 1 as turn, true as rebuilt union all select 2, false union all select 3, true")
def keyword_index_sync(spark, sf):
    """Whether the index is rebuilt: at first, for the same corpus, and after a document has come."""
    docs, index = read_table(spark, sf, "documents").select("doc_id", "text"), KeywordIndex(spark, folder(spark, "keywords"))
    more = docs.unionByName(docs.agg((F.max("doc_id") + 1).alias("doc_id"), F.lit("one more").alias("text")))
    turns = [index.sync(rows, "doc_id", "text") for rows in (docs, docs, more)]
    return frame(spark, ["turn", "rebuilt"], [(i + 1, t) for i, t in enumerate(turns)]).select(F.col("turn").cast("int").alias("turn"), "rebuilt")


@query("minmax_scores", f"with {_BM} select id as doc_id, round(raw, 6) as raw, score from bm")
def minmax_scores(spark, sf):
    return search.bm25(read_table(spark, sf, "documents"), QUERY, "doc_id", "text").select(F.col("id").alias("doc_id"), F.round("raw",
        6).alias("raw"), F.round("score", 6).alias("score"))


@query("keyword_idf_overlap_topk",
    f"""with h as (select doc_id, unnest(list_distinct(list_filter({TERMS_SQL}, lambda x: x in ('the','tion','thand','of','erer')))) as term from documents), f as (select term, count(*) as df from h group by term),
s as (select doc_id, round(sum(ln(((select count(*) from documents) + 1) / (df + 1)) + 1), 6) as score from h join f using (term) group by doc_id) select doc_id, score, row_number() over (order by score desc, doc_id)::int as rank from s order by score desc, doc_id limit {K}""")
def keyword_idf_overlap_topk(spark, sf):
    rows = search.idf_overlap(read_table(spark, sf, "documents"), QUERY, "doc_id", "text").withColumn("score", F.round("score", 6))
    return search.ranked(rows, "score", K, "id").select(F.col("id").alias("doc_id"), "score", "rank")


@query("keyword_tfidf_topk",
    f"""with t as (select doc_id, term, 1 + ln(count(*)) as tf from (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z0-9_./-]{{2,}}')) as term from documents) group by all),
i as (select term, ln((1 + (select count(*) from documents)) / (1 + count(*))) + 1 as idf from t group by term), w as (select doc_id, term, tf * idf as w from t join i using (term)),
n as (select doc_id, sqrt(sum(w * w)) as norm from w group by doc_id), q as (select term, (1 + ln(count(*))) * any_value(idf) as q from (select unnest(string_split('{QUERY_TEXT}', ' ')) as term) join i using (term) group by term),
s as (select doc_id, round(sum(w * q) / any_value(norm) / (select sqrt(sum(q * q)) from q), 6) as score from w join q using (term) join n using (doc_id) group by doc_id)
select doc_id, score, row_number() over (order by score desc, doc_id)::int as rank from s order by score desc, doc_id limit {K}""")
def keyword_tfidf_topk(spark, sf):
    rows = search.tfidf(read_table(spark, sf, "documents"), QUERY_TEXT, "doc_id", "text").withColumn("score", F.round("score", 6))
    return search.ranked(rows, "score", K, "id").select(F.col("id").alias("doc_id"), "score", "rank")


@query("keyword_index_tfidf_topk", SQL["keyword_tfidf_topk"])
def keyword_index_tfidf_topk(spark, sf):
    """The same from an index whose document frequencies and norms followed an add, a replacement, a removal and an add again."""
    docs, index = read_table(spark, sf, "documents").select("doc_id", "text", "lang"), KeywordIndex(spark, folder(spark, "norms"), norms=True)
    index.add(docs.filter("lang <> 'de'").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.reverse("text")).otherwise(F.col("text"))), "doc_id", "text")
    index.add(docs.filter("doc_id % 7 = 0 or lang = 'de'"), "doc_id", "text")
    index.remove(docs.filter("lang = 'es'"), "doc_id")
    index.add(docs.filter("lang = 'es'"), "doc_id", "text")
    rows = index.tfidf(QUERY_TEXT).withColumn("score", F.round("score", 6))
    return search.ranked(rows, "score", K, "id").select(F.col("id").alias("doc_id"), "score", "rank")


@query("l2_normalize", "with n as (select vec_id, list_transform(embedding::double[], lambda x: x / "
    "greatest(sqrt(list_inner_product(embedding::double[], embedding::double[])), 1e-10)) as v from embeddings) select vec_id, round(v[1], 6) as "
    "first, round(list_sum(v), 6) as total from n")
def l2_normalize(spark, sf):
    v = read_table(spark, sf, "embeddings").select("vec_id", search.l2_normalize(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("vector_topk", f"with s as ({_VEC}) select vec_id, score, row_number() over (order by score desc, vec_id)::int as rank from s order by score "
    f"desc, vec_id limit {K}")
def vector_topk(spark, sf):
    return search.vector_topk(read_table(spark, sf, "embeddings"), vector0(spark, sf), K).select("vec_id", "score", "rank")


@query("vector_filtered_topk", f"with s as (select * from ({_VEC}) where label = 3) select vec_id, score, row_number() over (order by score desc, "
    f"vec_id)::int as rank from s order by score desc, vec_id limit {K}")
def vector_filtered_topk(spark, sf):
    return search.vector_topk(read_table(spark, sf, "embeddings"), vector0(spark, sf), K, where={"label": 3, "unknown_key": "x"}).select("vec_id",
        "score", "rank")


@query("vector_nonnegative_topk", f"with s as (select vec_id, greatest(0, score) as score from ({_VEC})) select vec_id, score, row_number() over "
    f"(order by score desc, vec_id)::int as rank from s order by score desc, vec_id limit {K}")
def vector_nonnegative_topk(spark, sf):
    """The second backend's score: 1 - distance, never negative, without hash dedup."""
    q = F.array(*[F.lit(x) for x in vector0(spark, sf)])
    rows = read_table(spark, sf, "embeddings").withColumn("score", F.greatest(F.lit(0.0), F.round(search.cosine(F.col("embedding"), q), 6)))
    return search.ranked(rows, "score", K, "vec_id").select("vec_id", "score", "rank")


@query("vector_batch_topk", f"with s as (select q.vec_id as query_id, e.vec_id, round({_COS}, 6) as score from embeddings e, embeddings q where "
    f"q.vec_id % 50 = 0), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s) select query_id, "
    f"vec_id, score, rank from r where rank <= 5")
def vector_batch_topk(spark, sf):
    rows = read_table(spark, sf, "embeddings")
    return search.vector_batch_topk(rows, rows.filter("vec_id % 50 = 0"), 5)


@query("vector_index_topk", SQL["vector_topk"])
def vector_index_topk(spark, sf):
    """One query's cells of an index that was built of two thirds of the vectors, then extended, shrunk and extended again."""
    rows, index = read_table(spark, sf, "embeddings"), vector_index.VectorIndex(spark, folder(spark, "vectors"))
    index.build(rows.filter("label % 3 <> 0"))
    index.add(rows.filter("label % 3 = 0"))
    index.remove(rows.filter("label = 1"))
    index.add(rows.filter("label = 1"))
    return index.topk(vector0(spark, sf), K).select("vec_id", "score", "rank")


@query("vector_index_filtered_topk", SQL["vector_filtered_topk"])
def vector_index_filtered_topk(spark, sf):
    index = vector_index.VectorIndex(spark, folder(spark, "vectors"))
    index.build(read_table(spark, sf, "embeddings"))
    return index.topk(vector0(spark, sf), K, {"label": 3}).select("vec_id", "score", "rank")


@query("vector_index_batch_topk", SQL["vector_batch_topk"])
def vector_index_batch_topk(spark, sf):
    rows, index = read_table(spark, sf, "embeddings"), vector_index.VectorIndex(spark, folder(spark, "vectors"))
    index.build(rows)
    return index.batch_topk(rows.filter("vec_id % 50 = 0"), 5)


_HYB = f"""{_BM}, v as ({_VEC}), sem as (select vec_id as id, score from v order by score desc, vec_id limit 30), kw as (select id, score from bm where score > 0 order by score desc, id limit 30),
fu as (select id, coalesce(sem.score, 0) as semantic_score, coalesce(kw.score, 0) as keyword_score from sem full join kw using (id)),
hy as (select id, semantic_score, keyword_score, round(semantic_score * 0.7 + keyword_score * 0.3, 6) as final_score from fu)"""


def _hybrid(spark, sf, k=K, where=None):
    return search.hybrid(read_table(spark, sf, "documents"), read_table(spark, sf, "embeddings"), QUERY, vector0(spark, sf), k, where=where)


@query("hybrid_topk", f"with {_HYB} select id as doc_id, semantic_score, keyword_score, final_score, row_number() over (order by final_score desc, "
    f"id)::int as rank from hy order by final_score desc, id limit {K}")
def hybrid_topk(spark, sf):
    return _hybrid(spark, sf).withColumnRenamed("id", "doc_id")


@query("hybrid_index_topk", SQL["hybrid_topk"])
def hybrid_index_topk(spark, sf):
    """The same rows from stored indexes of both branches."""
    docs, rows = read_table(spark, sf, "documents"), read_table(spark, sf, "embeddings")
    keywords, cells = KeywordIndex(spark, folder(spark, "keywords")), vector_index.VectorIndex(spark, folder(spark, "vectors"))
    keywords.add(docs, "doc_id", "text")
    cells.build(rows)
    return search.hybrid(docs, rows, QUERY, vector0(spark, sf), K, keywords=keywords, cells=cells).withColumnRenamed("id", "doc_id")


@query("hybrid_filtered_topk", f"with {_HYB.replace('v as (' + _VEC + ')', 'v as (select * from (' + _VEC + ') where label = 3)')} select id as "
    f"doc_id, semantic_score, keyword_score, final_score, row_number() over (order by final_score desc, id)::int as rank from hy order by final_score "
    f"desc, id limit {K}")
def hybrid_filtered_topk(spark, sf):
    return _hybrid(spark, sf, where={"label": 3}).withColumnRenamed("id", "doc_id")


#: Merged candidates that are reranked before the cut to K.
_POOL = max(K, search.fetch_size(K))


@query("rerank_prefix", f"""with {_HYB}, r as (select *, row_number() over (order by final_score desc, id) as old from hy),
n as (select r.id, final_score as base_score, old, old <= {_POOL} as inside, round((coalesce({_COS}, 0) + 1) / 2, 6) as fresh from r left join embeddings e on e.vec_id = r.id, (select embedding from embeddings where vec_id = 0) q)
select id as doc_id, base_score, case when inside then fresh end as rerank_score, case when inside then fresh else base_score end as final_score,
row_number() over (order by inside desc, case when inside then fresh else 0 end desc, base_score desc, old)::int as rank from n order by rank limit {K}""")
def rerank_prefix(spark, sf):
    """Reranks the best of the whole merged list, then cuts to K."""
    both = search.hybrid(read_table(spark, sf, "documents"), read_table(spark, sf, "embeddings"), QUERY, vector0(spark, sf), K, keep=2 * search.fetch_size(K))
    return search.rerank(both, read_table(spark, sf, "embeddings"), vector0(spark, sf), _POOL, K).withColumnRenamed("id", "doc_id")


@query("postfilter_topk", f"with {_HYB.replace('limit 30', 'limit 90')}, r as (select * from hy order by final_score desc, id limit 30), p as (select "
    f"r.id, final_score from r join documents on doc_id = id where lang = 'en') select id as doc_id, final_score, row_number() over (order by "
    f"final_score desc, id)::int as rank from p order by final_score desc, id limit {K}")
def postfilter_topk(spark, sf):
    rows = _hybrid(spark, sf, search.fetch_size(K)).join(read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    return search.post_filtered(rows, F.col("lang") == "en", K).select(F.col("id").alias("doc_id"), "final_score", "rank")


@query("same_group_expand", f"with {_HYB}, r as (select id from hy order by final_score desc, id limit {K}) select doc_id, source, lang from "
    f"documents where source in (select source from documents where doc_id in (select id from r)) and lang = 'en'")
def same_group_expand(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "source", "lang")
    hits = _hybrid(spark, sf).select("id").join(docs, F.col("id") == F.col("doc_id")).select("id", "source")
    return search.same_group(hits, docs, "source", F.col("lang") == "en")


# ---- store


@query("content_hash_dedup", "with h as (select doc_id, sha256(coalesce(text, '')) as content_hash from documents) select min(doc_id) as doc_id, "
    "content_hash, row_number() over (order by min(doc_id)) - 1 as index_id from h group by content_hash")
def content_hash_dedup(spark, sf):
    docs = read_table(spark, sf, "documents")
    empty = docs.limit(0).select(F.lit("").alias("content_hash"), F.lit(0).cast("long").alias("index_id"))
    return store.insert_new(empty, docs, "doc_id").select("doc_id", "content_hash", "index_id")


@query("insert_new_rows", """with s as (select doc_id, sha256(coalesce(text, '')) as content_hash, doc_id as index_id from documents where lang = 'en'),
b as (select doc_id, sha256(coalesce(text, '')) as content_hash from documents), n as (select min(doc_id) as doc_id, content_hash from b where content_hash not in (select content_hash from s) group by content_hash)
select doc_id, content_hash, (select coalesce(max(index_id) + 1, 0) from s) + row_number() over (order by doc_id) - 1 as index_id from n""")
def insert_new_rows(spark, sf):
    docs = read_table(spark, sf, "documents")
    have = docs.filter("lang = 'en'").select(store.content_hash("text").alias("content_hash"), F.col("doc_id").alias("index_id"))
    return store.insert_new(have, docs, "doc_id").select("doc_id", "content_hash", "index_id")


@query("incremental_changed", "with r as (select 'd' || doc_id as file_path, sha256(case when doc_id % 7 = 0 then text || '!' else text end) as h "
    "from documents where lang <> 'de') select 'd' || doc_id as file_path, sha256(text) as content_hash from documents where not exists (select 1 "
    "from r where r.file_path = 'd' || doc_id and r.h = sha256(text))")
def incremental_changed(spark, sf):
    files = read_table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("file_path"), F.col("text").alias("content"),
        "doc_id", "lang")
    old = files.filter("lang <> 'de'").withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return store.changed(files, store.registry_of(old)).select("file_path", "content_hash")


@query("upsert_last_wins", "with b as (select l_orderkey as k, max_by(l_quantity, l_linenumber) as v from lineitem where l_returnflag = 'R' group by "
    "l_orderkey) select o_orderkey as k, coalesce(v, o_totalprice) as v from orders left join b on k = o_orderkey union all select k, v from b where "
    "k not in (select o_orderkey from orders)")
def upsert_last_wins(spark, sf):
    have = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    batch = read_table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("v"),
        F.col("l_linenumber").alias("ord"))
    return store.upsert(have, batch, "k", "ord")


@query("keyed_table_versions", """with a as (select 1 as version, o_orderkey, o_totalprice, o_orderstatus from orders),
l as (select l_orderkey as o_orderkey, max_by(l_quantity, l_linenumber * 1000 + l_quantity) as q from lineitem where l_returnflag = 'R' and l_orderkey % 10 = 3 group by l_orderkey),
b as (select 2 as version, o_orderkey, coalesce(q, o_totalprice) as o_totalprice, case when q is null then o_orderstatus else 'R' end as o_orderstatus from a left join l using (o_orderkey)
  union all select 2, o_orderkey, q, 'R' from l where o_orderkey not in (select o_orderkey from orders)),
c as (select 3 as version, o_orderkey, o_totalprice, o_orderstatus from b where o_orderkey not in (select o_orderkey from orders where o_custkey % 100 = 7))
select version, count(*) as n, sum(o_orderkey)::bigint as keys, round(sum(o_totalprice), 2) as total, sum((o_orderstatus = 'R')::int)::bigint as returned from (from a union all from b union all from c) group by version""")
def keyed_table_versions(spark, sf):
    """orders as a keyed table: an upsert of returned quantities, replayed once, then a deletion; all three versions are read."""
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey")
    table = KeyedTable(spark, folder(spark, "orders"), "o_orderkey", orders.drop("o_custkey").schema)
    table.upsert(orders.drop("o_custkey"), name="load")
    back = read_table(spark, sf, "lineitem").filter("l_returnflag = 'R' and l_orderkey % 10 = 3")
    back = back.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("o_totalprice"), F.lit("R").alias("o_orderstatus"),
        (F.col("l_linenumber") * 1000 + F.col("l_quantity")).alias("ord"))
    table.upsert(back, order="ord", name="returns")
    table.upsert(back, order="ord", name="returns")
    table.delete(orders.filter("o_custkey % 100 = 7"))
    each = [table.read(v).withColumn("version", F.lit(v)) for v in table.versions()]
    rows = each[0].unionByName(each[1]).unionByName(each[2])
    return rows.groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.sum((F.col("o_orderstatus") == "R").cast("long")).alias("returned"))


@query("keyed_table_upsert", SQL["upsert_last_wins"])
def keyed_table_upsert(spark, sf):
    """The rows of upsert_last_wins from a keyed table."""
    have = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    batch = read_table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("v"),
        F.col("l_linenumber").alias("ord"))
    table = KeyedTable(spark, folder(spark, "keyed"), "k", have.schema)
    table.upsert(have)
    table.upsert(batch, order="ord")
    return table.read()


@query("delete_by_key", "select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def delete_by_key(spark, sf):
    gone = read_table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return store.delete(read_table(spark, sf, "orders"), gone, "o_custkey").select("o_orderkey", "o_custkey")


@query("update_replace",
    """with s as (select doc_id, sha256(coalesce(text, '')) as content_hash, doc_id as index_id from documents where lang in ('en', 'fr')), b as (select doc_id, sha256(coalesce(text, '')) as content_hash from documents where lang in ('fr', 'es')),
k as (select * from s where doc_id not in (select doc_id from b)), n as (select min(doc_id) as doc_id, content_hash from b where content_hash not in (select content_hash from k) group by content_hash)
select * from k union all select doc_id, content_hash, (select coalesce(max(index_id) + 1, 0) from k) + row_number() over (order by doc_id) - 1 from n""")
def update_replace(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "lang")
    have = docs.filter("lang in ('en', 'fr')").select("doc_id", store.content_hash("text").alias("content_hash"), F.col("doc_id").alias("index_id"))
    return store.replace(have, docs.filter("lang in ('fr', 'es')").drop("lang"), "doc_id", "doc_id")


@query("next_id", "select (select coalesce(max(vec_id) + 1, 0) from embeddings) as next_id, (select count(*) from embeddings) as total")
def next_id(spark, sf):
    rows = read_table(spark, sf, "embeddings")
    return store.next_id(rows, "vec_id").crossJoin(rows.agg(F.count(F.lit(1)).alias("total")))


@query("metadata_filter", "select doc_id, n_chars from documents where lang = 'fr' and source = 'src3'")
def metadata_filter(spark, sf):
    rows = read_table(spark, sf, "documents").withColumnsRenamed({"lang": "file_type", "source": "file_path"})
    return store.metadata_filter(rows, {"file_type": "fr", "file_path": "src3", "no_such_key": 1}).select("doc_id", "n_chars")


@query("exists_by_hash", "select item_id, sha256(text) in (select sha256(coalesce(text, '')) from documents) as present from benchmark")
def exists_by_hash(spark, sf):
    have = read_table(spark, sf, "documents").select(store.content_hash("text").alias("content_hash"))
    return store.exists_by_hash(read_table(spark, sf, "benchmark"), have).select("item_id", "present")


@query("chunk_view", "select event_id, coalesce(json_extract_string(props, '$.k'), '') as k from events")
def chunk_view(spark, sf):
    rows = store.chunk_view(read_table(spark, sf, "events").select("event_id", F.col("props").alias("metadata_json")))
    return rows.select("event_id", F.coalesce(F.try_element_at("metadata", F.lit("k")), F.lit("")).alias("k"))


@query("embed_distinct_texts", "select doc_id, sha256(coalesce(text, '')) as content_hash, 64 as dimension from documents")
def embed_distinct_texts(spark, sf):
    rows = store.embed(read_table(spark, sf, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "content_hash", F.size("embedding").alias("dimension"))
