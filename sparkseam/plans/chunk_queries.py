"""Chunking, dependency, classification and rule queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkseam.functions import classify as C
from sparkseam.functions import text as T
from sparkseam.operators import chunking, rules, search
from sparkseam.plans.fixtures import beside, frame, pick, pick_sql, printf_sql, values
from sparkseam.session import read_table

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


W = "regexp_extract_all(coalesce(text, ''), '\\S+')"


def window_sql(size: int, overlap: int) -> str:
    return f"""select doc_id, (s / {size - overlap})::int as chunk_index, array_to_string(w[s + 1 : s + {size}], ' ') as chunk from (select doc_id, w, unnest(range(0, greatest(len(w) - {overlap} - 1, 0) + 1, {size - overlap})) as s from (select doc_id, {W} as w from documents) where len(w) > 0)"""


@query("chunk_fixed_windows", window_sql(200, 50))
def chunk_fixed_windows(spark, sf):
    return chunking.fixed_windows(read_table(spark, sf, "documents").select("doc_id", "text"), 200, 50).select("doc_id", "chunk_index", "chunk")


@query("chunk_hybrid_split", f"select doc_id, 0 as chunk_index, text as chunk from documents where text <> '' and len({W}) <= 300 union all select * "
    f"from ({window_sql(300, 30)}) where doc_id in (select doc_id from documents where len({W}) > 300)")
def chunk_hybrid_split(spark, sf):
    rows = read_table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.split_by(F.col("text"), 300, 30, "hybrid")).alias("chunk_index", "chunk"))
    return rows


@query("chunk_semantic_whole", "select doc_id, text as chunk from documents")
def chunk_semantic_whole(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", F.explode(chunking.split_by(F.col("text"), 300, 30, "semantic")).alias("chunk"))


_ID = "substr(regexp_replace(regexp_replace(regexp_replace(x, '[^a-zA-Z0-9_]', '_', 'g'), '^_+|_+$', '', 'g'), '_+', '_', 'g'), 1, 120)"


@query("chunk_fallback_records",
    f"select {_ID.replace('x,', chr(39) + 'd' + chr(39) + ' || doc_id || ' + chr(39) + '_yaml_fixed_' + chr(39) + ' || chunk_index,')} as chunk_id, "
    f"chunk_index, 'fixed_window' as block_type, chunk as text, greatest(1, len(regexp_extract_all(chunk, '\\S+')))::int as tokens from (select "
    f"doc_id, 0 as chunk_index, text as chunk from documents where text <> '' and len({W}) <= 300 union all select * from ({window_sql(300, 30)}) "
    f"where doc_id in (select doc_id from documents where len({W}) > 300))")
def chunk_fallback_records(spark, sf):
    files = read_table(spark, sf, "documents").select(F.concat(F.lit("a/b/d"), F.col("doc_id"), F.lit(".yaml")).alias("file_path"),
        F.lit("yaml").alias("file_type"), F.col("text").alias("content"))
    return chunking.fallback_chunks(files, 300, 30).select("chunk_id", "chunk_index", "block_type", "text", "tokens")


@query("chunk_id_sanitize", f"select page_id, {_ID.replace('x,', 'url,')} as chunk_id from pages")
def chunk_id_sanitize(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", T.chunk_id(F.col("url")).alias("chunk_id"))


@query("token_count", f"select doc_id, greatest(1, len({W}))::int as tokens, greatest(1, floor(len({W}) * 0.75))::int as estimate from documents")
def token_count(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", chunking.token_count(F.col("text")).cast("int").alias("tokens"),
        T.token_estimate(F.col("text")).alias("estimate"))


TF = ["file_path", "content"]
TF_ROWS = [
    ("net/main.tf", 'resource "aws_vpc" "main" {\n  cidr = var.cidr\n  tags = { note = "a } brace" }\n}\n\nvariable "cidr" {\n  default = '
        '"10.0.0.0/16"\n}\n\nmodule "peer" {\n  source = "./peer"\n  vpc = aws_vpc.main.id\n  zone = data.aws_zone.z.id\n  l = local.tags\n}\n\ndata '
        '"aws_zone" "z" {\n  name = module.peer.name\n}\n\nlocals {\n  tags = join(",", [var.cidr, var.cidr])\n}\n\noutput "id" {\n  value = '
        'aws_vpc.main.id\n}\n'),
    ("net/broken.tf", 'resource "aws_s3_bucket" "b" {\n  acl = "public-read"\n'),
    ("net/none.tf", "# only a comment here\n"),
]
TF_EXPECTED = [
    ("main_resource_aws_vpc_main", "resource", "aws_vpc", "main", 0, "var.cidr"),
    ("main_variable_cidr", "variable", "", "cidr", 1, ""),
    ("main_module_peer", "module", "", "peer", 2, "aws_vpc.main,aws_zone.z,local.tags"),
    ("main_data_aws_zone_z", "data", "aws_zone", "z", 3, "module.peer"),
    ("main_locals", "locals", "", "", 4, "var.cidr"),
    ("main_output_id", "output", "", "id", 5, "aws_vpc.main"),
    ("broken_resource_aws_s3_bucket_b", "resource", "aws_s3_bucket", "b", 0, ""),
    ("none_terraform_fixed_0", "fixed_window", "", "", 0, ""),
]
_BLOCK = ["chunk_id", "block_type", "resource_type", "block_name", "chunk_index", "dependencies"]



# Files that every part, customer and order stands for, and the blocks they have.
PART_TF = ('variable "v%d" {\n  default = "%s"\n}\n\nresource "aws_vpc" "n%d" {\n  cidr = var.v%d\n  tags = { note = "a } brace" }\n}\n\noutput "o%d" {\n'
    '  value = aws_vpc.n%d.id\n%s}\n')
_ALSO = "  depends_on = [module.m]\n"
_PART_SQL = "select 'parts/p' || p_partkey || '.tf' as file_path, " + printf_sql(PART_TF, "p_partkey", "p_brand", "p_partkey", "p_partkey", "p_partkey",
    "p_partkey", f"case when p_size % 2 = 0 then '{_ALSO}' else '' end") + " as content from part"
_PART_BLOCKS = """select 'p' || k || '_variable_v' || k as chunk_id, 'variable' as block_type, '' as resource_type, 'v' || k as block_name, 0::bigint as chunk_index, '' as dependencies from (select p_partkey as k from part)
 union all select 'p' || k || '_resource_aws_vpc_n' || k, 'resource', 'aws_vpc', 'n' || k, 1, 'var.v' || k from (select p_partkey as k from part)
 union all select 'p' || k || '_output_o' || k, 'output', '', 'o' || k, 2, 'aws_vpc.n' || k || case when p_size % 2 = 0 then ',module.m' else '' end from (select p_partkey as k, p_size from part)"""
CUSTOMER_YAML = "kind: Pod\nmetadata:\n  name: c%d\nspec:\n  image: ${IMG%d}\n---\nkind: Service\nmetadata:\n  name: s%d\n"
_CUSTOMER_SQL = "select 'k/c' || c_custkey || '.yaml' as file_path, " + printf_sql(CUSTOMER_YAML, "c_custkey", "c_nationkey",
    "c_custkey") + " as content from customer"
_CUSTOMER_BLOCKS = """select 'c' || k || '_yaml_Pod_c' || k as chunk_id, 'kind' as block_type, 'Pod' as resource_type, 'c' || k as block_name, 0::bigint as chunk_index, 'IMG' || n as dependencies from (select c_custkey as k, c_nationkey as n from customer)
 union all select 'c' || k || '_yaml_Service_s' || k, 'kind', 'Service', 's' || k, 1, '' from (select c_custkey as k from customer)"""
ORDER_JSON = ('{"Version": "2012", "Statement": [{"Sid": "S%d", "Resource": "arn:aws:s3:::b%d"}, {"Effect": "Allow", "Resource": {"Ref": "R%d"}}]}')
_ORDER_BLOCKS = """select 'o' || k || '_json_header' as chunk_id, 'policy_header' as block_type, '' as resource_type, 'header' as block_name, 0::bigint as chunk_index, '' as dependencies from (select o_orderkey as k from orders)
 union all select 'o' || k || '_json_S' || k, 'statement', '', 'S' || k, 1, 'arn:aws:s3:::b' || c from (select o_orderkey as k, o_custkey as c from orders)
 union all select 'o' || k || '_json_1', 'statement', '', '1', 2, 'R' || k from (select o_orderkey as k from orders)"""


def part_files(spark, sf):
    k = F.col("p_partkey")
    return read_table(spark, sf, "part").select(F.format_string("parts/p%d.tf", k).alias("file_path"), F.format_string(PART_TF, k, "p_brand", k, k, k, k,
        F.when(F.col("p_size") % 2 == 0, _ALSO).otherwise("")).alias("content"))


def customer_files(spark, sf):
    k = F.col("c_custkey")
    return read_table(spark, sf, "customer").select(F.format_string("k/c%d.yaml", k).alias("file_path"), F.format_string(CUSTOMER_YAML, k, "c_nationkey",
        k).alias("content"))


def order_files(spark, sf):
    k = F.col("o_orderkey")
    return read_table(spark, sf, "orders").select(F.format_string("p/o%d.json", k).alias("file_path"), F.format_string(ORDER_JSON, k, "o_custkey",
        k).alias("content"))


def _chunks(spark, rows, kind, more):
    files = frame(spark, TF, rows).unionByName(more).withColumn("file_type", F.lit(kind))
    return chunking.structured_chunks(files)


def _flat(chunks):
    return chunks.select("chunk_id", "block_type", "resource_type", "block_name", F.col("chunk_index").cast("long"), F.array_join("dependencies",
        ",").alias("dependencies"))


@query("tf_block_split", f"select * from {beside(_BLOCK, TF_EXPECTED, _PART_BLOCKS)}")
def tf_block_split(spark, sf):
    return _flat(_chunks(spark, TF_ROWS, "terraform", part_files(spark, sf)))


@query("tf_dependencies", """with c as (select * from """ + beside(TF,
    TF_ROWS, _PART_SQL) + """), r as (select file_path, unnest(list_concat(regexp_extract_all(content, '\\bvar\\.[a-zA-Z_]\\w*\\b'), regexp_extract_all(content, '\\blocal\\.[a-zA-Z_]\\w*\\b'), regexp_extract_all(content, '\\bmodule\\.[a-zA-Z_]\\w*\\b'), regexp_extract_all(content, '\\bdata\\.[a-zA-Z_]\\w+\\.[a-zA-Z_]\\w+\\b'), regexp_extract_all(content, '\\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\\.[a-zA-Z_]\\w*\\b'))) as ref from c) select distinct file_path, ref from r""")
def tf_dependencies(spark, sf):
    files = frame(spark, TF, TF_ROWS).unionByName(part_files(spark, sf))
    return files.select("file_path", F.explode(chunking.tf_dependencies(F.col("content"))).alias("ref"))


YAML_ROWS = [
    ("k/pod.yaml", "kind: Pod\nmetadata:\n  name: web\nspec:\n  image: ${IMAGE}\n---\nkind: Service\nmetadata:\n  name: svc\n"),
    ("k/values.yaml", "a: 1\nb:\n  - var.region\n"),
    ("k/list.yaml", "- x: 1\n- y: 2\n"),
    ("k/bad.yaml", "a: [1\nb: }\n"),
]
YAML_EXPECTED = [("pod_yaml_Pod_web", "kind", "Pod", "web", 0, "IMAGE"), ("pod_yaml_Service_svc", "kind", "Service", "svc", 1, ""), ("values_yaml_a",
    "key", "", "a", 0, ""), ("values_yaml_b", "key", "", "b", 1, "region"), ("list_yaml_0", "item", "", "0", 0, ""), ("list_yaml_1", "item", "", "1",
    1, ""), ("bad_yaml_fixed_0", "fixed_window", "", "", 0, "")]


@query("yaml_block_split", f"select * from {beside(_BLOCK, YAML_EXPECTED, _CUSTOMER_BLOCKS)}")
def yaml_block_split(spark, sf):
    return _flat(_chunks(spark, YAML_ROWS, "yaml", customer_files(spark, sf)))


@query("yaml_doc_split", "with c as (select file_path, unnest(list_filter(regexp_split_to_array(content, '(?m)^---[ \\t]*$'), lambda x: "
    "regexp_matches(x, '\\S'))) as document from " + beside(TF, YAML_ROWS, _CUSTOMER_SQL) + ") select file_path, document from c")
def yaml_doc_split(spark, sf):
    files = frame(spark, TF, YAML_ROWS).unionByName(customer_files(spark, sf))
    return files.select("file_path", F.explode(chunking.yaml_documents(F.col("content"))).alias("document"))


JSON_ROWS = [
    ("p/policy.json", '{"Version": "2012", "Statement": [{"Sid": "Read", "Resource": "arn:aws:s3:::b"}, {"Effect": "Allow", "Resource": {"Ref": "Bucket"}}]}'),
    ("p/map.json", '{"a": "${Env}", "b": 2}'),
    ("p/list.json", "[1, {\"k\": 2}]"),
    ("p/bad.json", "{not json"),
]
JSON_EXPECTED = [("policy_json_header", "policy_header", "", "header", 0, ""), ("policy_json_Read", "statement", "", "Read", 1, "arn:aws:s3:::b"),
    ("policy_json_1", "statement", "", "1", 2, "Bucket"), ("map_json_a", "key", "", "a", 0, "Env"), ("map_json_b", "key", "", "b", 1, ""),
    ("list_json_0", "item", "", "0", 0, ""), ("list_json_1", "item", "", "1", 1, ""), ("bad_json_fixed_0", "fixed_window", "", "", 0, "")]


@query("json_statement_split", f"select * from {beside(_BLOCK, JSON_EXPECTED, _ORDER_BLOCKS)}")
def json_statement_split(spark, sf):
    return _flat(_chunks(spark, JSON_ROWS, "json", order_files(spark, sf)))


@query("chunk_router", f"select * from ({' union all '.join('select * from ' + beside(_BLOCK, r, q) for r, q in ((TF_EXPECTED, _PART_BLOCKS), (YAML_EXPECTED, _CUSTOMER_BLOCKS), (JSON_EXPECTED, _ORDER_BLOCKS)))})")
def chunk_router(spark, sf):
    files = frame(spark, TF, TF_ROWS + YAML_ROWS + JSON_ROWS)
    for more in (part_files, customer_files, order_files):
        files = files.unionByName(more(spark, sf))
    kind = F.when(F.col("file_path").endswith(".tf"), "terraform").when(F.col("file_path").endswith(".json"), "json").otherwise("yaml")
    return _flat(chunking.structured_chunks(files.withColumn("file_type", kind)))


DEP = ["ord", "chunk_id", "block_type", "resource_type", "block_name", "dependencies"]
DEP_ROWS = [
    (1, "c_var", "variable", "", "region", ()),
    (2, "c_vpc", "resource", "aws_vpc", "main", ("var.region", "var.missing")),
    (3, "c_mod", "module", "", "peer", ("aws_vpc.main", "local.x")),
    (4, "c_data", "data", "aws_zone", "z", ("module.peer",)),
    (5, "c_out", "output", "", "id", ("data.aws_zone.z", "aws_vpc.main")),
    (6, "c_var2", "variable", "", "region", ()),
    (7, "c_loc", "locals", "", "", ("c_var",)),
]
_KINDS = ["variable", "resource", "module", "data"]
_ORDER_DEPS = f"select 100 + o_orderkey, 'n' || o_orderkey, {pick_sql(_KINDS, 'o_orderkey')}, case when o_orderkey % 2 = 1 then 'aws_x' else '' end, 'b' || (o_orderkey % 5000), ['var.b' || (o_custkey * 4 % 5000), 'aws_x.b' || (o_custkey % 5000), 'n' || o_custkey] from orders"
_SYM = f"""e as (select * from {beside(DEP, DEP_ROWS, _ORDER_DEPS)}), s as (select ref, max_by(chunk_id, ord) as target from (select *, case when block_type = 'variable' and block_name <> '' then 'var.' || block_name when block_type in ('output', 'module') and block_name <> '' then block_type || '.' || block_name when block_type = 'locals' then 'locals' when block_type = 'resource' and block_name <> '' and resource_type <> '' then resource_type || '.' || block_name when block_type = 'data' and block_name <> '' and resource_type <> '' then 'data.' || resource_type || '.' || block_name end as ref from e) where ref is not null group by ref),
g as (select chunk_id as src, i, coalesce((select target from s where ref = d), d) as dst from (select chunk_id, unnest(dependencies) as d, unnest(range(len(dependencies))) as i from e))"""


def _deps(spark, sf):
    """Fixed chunks, and one for each order that names variables, resources and chunks by its customer's number."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = read_table(spark, sf, "orders").select((o + 100).alias("ord"), F.concat(F.lit("n"), o).alias("chunk_id"), pick(_KINDS, o).alias("block_type"),
        F.when(o % 2 == 1, "aws_x").otherwise("").alias("resource_type"), F.concat(F.lit("b"), o % 5000).alias("block_name"), F.array(F.concat(
        F.lit("var.b"), c * 4 % 5000), F.concat(F.lit("aws_x.b"), c % 5000), F.concat(F.lit("n"), c)).alias("dependencies"))
    return frame(spark, DEP, [(*r[:5], "|".join(r[5])) for r in DEP_ROWS]).withColumn("dependencies", F.filter(F.split("dependencies", r"\|"),
        lambda x: x != "")).unionByName(orders)


@query("dependency_symbols", f"with {_SYM} select ref, target from s")
def dependency_symbols(spark, sf):
    return chunking.symbols(_deps(spark, sf), "ord")


@query("dependency_resolve", f"with {_SYM} select e.chunk_id, coalesce((select string_agg(dst, ',' order by i) from g where src = e.chunk_id), '') as "
    f"dependencies from e")
def dependency_resolve(spark, sf):
    return chunking.resolve(_deps(spark, sf), "ord").select("chunk_id", F.array_join("dependencies", ",").alias("dependencies"))


def _edges(spark, sf):
    return chunking.resolve(_deps(spark, sf), "ord").select(F.col("chunk_id").alias("src"), F.explode("dependencies").alias("dst"))


_BFS = f"""with recursive {_SYM}, b(id, level) as (select chunk_id, 0 from e where chunk_id = 'c_out' or (ord - 100) % 50 = 0 union select dst, level + 1 from b join g on src = id where level < 2 and dst in (select chunk_id from e)), m as (select id, min(level)::int as level from b group by id)"""


@query("dependency_bfs", f"{_BFS} select id, level from m")
def dependency_bfs(spark, sf):
    """From the fixed seed and from every fiftieth order."""
    seeds = _deps(spark, sf).filter("chunk_id = 'c_out' or (ord - 100) % 50 = 0").select(F.col("chunk_id").alias("id"))
    return chunking.expand(_edges(spark, sf), seeds, _deps(spark, sf).select(F.col("chunk_id").alias("id")), 3)


@query("dependency_append", f"{_BFS} select 'c_out' as id, 0.9::double as score, 1 as rank union all select id, 0::double, (1 + row_number() over "
    f"(order by level, id))::int from m where id <> 'c_out'")
def dependency_append(spark, sf):
    ranked = spark.range(1).select(F.lit("c_out").alias("id"), F.lit(0.9).alias("score"), F.lit(1).alias("rank"))
    return chunking.append_dependencies(ranked, dependency_bfs(spark, sf))


@query("dependency_graph", f"with {_SYM} select e.chunk_id, (select count(*) from g where src = e.chunk_id) as n_out, (select count(*) from g where "
    f"dst = e.chunk_id) as n_in from e")
def dependency_graph(spark, sf):
    edges = _edges(spark, sf)
    out, into = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n_out")), edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n_in"))
    rows = _deps(spark, sf).select("chunk_id")
    return rows.join(out, rows["chunk_id"] == out["src"], "left").join(into, rows["chunk_id"] == into["dst"], "left").select("chunk_id",
        F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


# ---- classification


def case_sql(probe: str, groups: list[tuple[str, list[str]]], default: str) -> str:
    whens = " ".join("when " + " or ".join(f"contains({probe}, '{n}')" for n in needles) + f" then '{name}'" for name, needles in groups)
    return f"case {whens} else '{default}' end"


PROV = ["resource_type", "content", "file_path"]
PROV_ROWS = [("aws_vpc", "", ""), ("azurerm_x", "aws-", ""), ("google_a_b", "", ""), ("helm_release", "", ""), ("", "uses us-east-1 and azure", ""),
    ("", "x", "deploy/azure.tf"), ("", "gcloud run", ""), ("", "kind: Pod", ""), ("odd_type", "", ""), ("", "", "")]
_PROV = f"""case split_part(lower(resource_type), '_', 1) {' '.join(f"when '{k}' then '{v}'" for k, v in C.PROVIDER_PREFIXES.items())} else {case_sql("lower(content || ' ' || file_path)", C.PROVIDER_KEYWORDS, 'unknown')} end"""


@query("provider_detect", f"with a as (select * from {values(PROV, PROV_ROWS)} union all select '', text, source from documents union all select '', "
    f"html, url from pages) select {_PROV} as provider, count(*) as n from a group by 1")
def provider_detect(spark, sf):
    docs = read_table(spark, sf, "documents").select(F.lit("").alias("resource_type"), F.col("text").alias("content"), F.col("source").alias("file_path"))
    pages = read_table(spark, sf, "pages").select(F.lit("").alias("resource_type"), F.col("html").alias("content"), F.col("url").alias("file_path"))
    rows = frame(spark, PROV, PROV_ROWS).unionByName(docs).unionByName(pages)
    return rows.groupBy(C.provider(F.col("resource_type"), F.col("content"), F.col("file_path")).alias("provider")).agg(F.count(F.lit(1)).alias("n"))


TAG = ["chunk_id", "file_type", "text", "file_path", "resource_type", "cloud_provider", "category"]
TAG_ROWS = [
    ("t1", "terraform", 'resource "aws_s3_bucket" "b" {', "a.tf", "", "", ""),
    ("t2", "terraform", 'data "google_project" "p" {', "a.tf", "", "", ""),
    ("t3", "yaml", "apiVersion: v1\nkind: Pod\n", "p.yaml", "", "", ""),
    ("t4", "json", "{}", "x.json", "custom_thing", "google", "identity"),
    ("t5", "yaml", "plain", "x.yaml", "", "K8S", ""),
]
_RT = r"""case when resource_type <> '' then resource_type when file_type = 'terraform' then coalesce(nullif(regexp_extract(text, 'resource\s+"([^"]+)"\s+"[^"]+"', 1), ''), regexp_extract(text, 'data\s+"([^"]+)"\s+"[^"]+"', 1)) when file_type in ('yaml', 'json') then regexp_extract(text, '(?m)^kind\s*:\s*([A-Za-z0-9_\-]+)', 1) else '' end"""
_TAG_KINDS = ["terraform", "yaml", "json"]
_DOC_TAG = f"""select 'd' || doc_id, {pick_sql(_TAG_KINDS, 'doc_id')}, case doc_id % 3 when 0 then 'resource "aws_' || lang || '" "b" ' when 1 then 'kind: ' || lang || chr(10) else '' end || coalesce(text, ''), source, '', case when doc_id % 5 = 0 then 'K8S' else '' end, '' from documents"""
_TAGGED = f"""t as (select chunk_id, {_RT} as rt, text, file_path, cloud_provider as cp, category as ct from {beside(TAG, TAG_ROWS, _DOC_TAG)}),
p as (select *, lower(case when cp <> '' then cp else {_PROV.replace('resource_type', 'rt').replace('content', 'text')} end) as pr from t),
tagged as (select chunk_id, rt as resource_type, case pr when 'google' then 'gcp' when 'k8s' then 'kubernetes' when '' then 'unknown' else pr end as cloud_provider, case when ct <> '' then ct else {case_sql("lower(rt || ' ' || text)", C.CATEGORIES, 'general')} end as category from p)"""


def tag(rows):
    kind = C.filled(F.col("resource_type"), C.resource_type(F.col("file_type"), F.col("text")))
    cloud = C.provider_alias(C.filled(F.col("cloud_provider"), C.provider(kind, F.col("text"), F.col("file_path"))))
    return rows.select("chunk_id", kind.alias("resource_type"), cloud.alias("cloud_provider"), C.filled(F.col("category"), C.category(kind,
        F.col("text"))).alias("category"))


def to_tag(spark, sf):
    """Fixed chunks, and the documents as files of three kinds."""
    d = F.col("doc_id")
    head = F.when(d % 3 == 0, F.concat(F.lit('resource "aws_'), "lang", F.lit('" "b" '))).when(d % 3 == 1, F.concat(F.lit("kind: "), "lang",
        F.lit("\n"))).otherwise("")
    docs = read_table(spark, sf, "documents").select(F.concat(F.lit("d"), d).alias("chunk_id"), pick(_TAG_KINDS, d).alias("file_type"), F.concat(head,
        F.coalesce("text", F.lit(""))).alias("text"), F.col("source").alias("file_path"), F.lit("").alias("resource_type"), F.when(d % 5 == 0,
        "K8S").otherwise("").alias("cloud_provider"), F.lit("").alias("category"))
    return frame(spark, TAG, TAG_ROWS).unionByName(docs)


@query("resource_tag", f"with {_TAGGED} select * from tagged")
def resource_tag(spark, sf):
    return tag(to_tag(spark, sf))


@query("resource_matches", f"with {_TAGGED} select resource_type, cloud_provider, category, min(substr(chunk_id, 2)::int) as rank from tagged group by all")
def resource_matches(spark, sf):
    rows = tag(to_tag(spark, sf)).withColumn("rank", F.substring("chunk_id", 2, 9).cast("int"))
    return rows.groupBy("resource_type", "cloud_provider", "category").agg(F.min("rank").alias("rank"))


@query("category_infer", f"select {case_sql('lower(text)', C.CATEGORIES, 'general')} as category, count(*) as n from documents group by 1")
def category_infer(spark, sf):
    return read_table(spark, sf, "documents").groupBy(C.category(F.lit(""), F.col("text")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


INT = ["qid", "text", "label"]
INT_ROWS = [("1", "Who has the Owner role assignment?", ""), ("2", "check OIDC issuer", ""), ("3", "find hardcoded password", ""),
    ("4", "github actions workflow", ""), ("5", "open port 22 ingress", ""), ("6", "are we nist compliant", ""), ("7", "hello", ""),
    ("8", "path of files", ""), ("9", "anything", "network"), ("10", "anything iam", "nonsense")]


@query("intent_route", f"with a as (select qid, text, label from {values(INT, INT_ROWS)} union all select 'b' || item_id, text, '' from benchmark) "
    f"select qid, case when label <> '' then case when label in "
    f"('iam','workload_identity','secrets','prompt_injection','network','compliance','general_security') then label else 'general_security' end "
    f"else {case_sql('lower(text)', C.INTENTS, C.DEFAULT_INTENT)} end as intent from a")
def intent_route(spark, sf):
    bench = read_table(spark, sf, "benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("qid"), "text", F.lit("").alias("label"))
    return frame(spark, INT, INT_ROWS).unionByName(bench).select("qid", C.routed(F.col("text"), F.col("label")).alias("intent"))


# ---- rules

RAW = ["id", "category", "severity", "title", "description", "indicators", "references", "resource_type", "cloud_provider"]
RAW_ROWS = [
    ("custom-1", "azure", "high", "Blob exposure", "public blob", "", "", "", ""),
    ("custom-2", "aws", "CRITICAL", "S3 bucket open", "", "acl", "", "", ""),
    ("custom-3", "cis_k8s", "MEDIUM", "pods", "container runs", "", "", "", ""),
    ("custom-4", "general", "LOW", "password rule", "", "", "", "", "all"),
    ("custom-5", "networking", "INFO", "anything", "", "", "", "typed_thing", ""),
    ("custom-6", "gcp", "HIGH", "nothing special", "", "", "", "", ""),
    ("gcp-01", "gcp", "HIGH", "replaced", "", "", "", "google_storage_bucket", "gcp"),
]
_PROBE = "lower(title || ' ' || description || ' ' || indicators || ' ' || \"references\" || ' ' || category)"
_SOURCES, _LEVELS = ["aws", "azure", "gcp", "cis_k8s", "identity", "general"], ["LOW", "high", "CRITICAL"]
_ABOUT = ["storage bucket", "pod security", "password in text", "iam role", "firewall", "plain", "virtual machine"]
_PART_RULES = f"select 'p' || p_partkey, {pick_sql(_SOURCES, 'p_size')}, {pick_sql(_LEVELS, 'p_size')}, p_name, {pick_sql(_ABOUT, 'p_partkey')}, '', '', '', '' from part"
_NORM = f"""n as (select *, {_PROBE} as probe from {beside([*RAW[:6], '"references"', *RAW[7:]], RAW_ROWS, _PART_RULES)}),
m as (select *, case when resource_type <> '' then resource_type else {case_sql('probe', rules.RULE_TYPES, 'general')} end as rt0 from n),
m1 as (select *, case when rt0 = '*storage' then case when contains(probe, 'azure') then 'azurerm_storage_account' else 'storage' end else rt0 end as rt from m),
norm as (select id as rule_id, category as source_category, upper(severity) as severity, rt as resource_type,
 case when cloud_provider <> '' then cloud_provider when contains(category || probe, 'azure') then 'azure' when contains(category || probe, 'aws') or contains(probe, 's3') then 'aws' when contains(category, 'gcp') or contains(probe, 'google') then 'gcp' when contains(category, 'k8s') or contains(probe, 'kubernetes') then 'kubernetes' else 'generic' end as cloud_provider,
 case when category in ('identity','networking','secrets','compute','storage') then category else coalesce(case rt {' '.join(f"when '{k}' then '{v}'" for k, v in rules.TYPE_CATEGORIES.items())} end, {case_sql('probe', [("storage", ["storage", "bucket", "blob"]), ("secrets", ["secret", "password", "token"]), ("networking", ["network", "firewall", "security group"]), ("identity", ["identity", "iam", "role"]), ("compute", ["compute", "vm", "pod", "container"])], 'general')}) end as category, title from m1),
cat as (select * from {values(rules.FIELDS, rules.built_in_rows())} where rule_id not in (select rule_id from norm) union all select * from norm)"""


def _raw_rules(spark, sf):
    """Fixed rules, and one for each part."""
    k, none = F.col("p_partkey"), F.lit("")
    own = [F.concat(F.lit("p"), k), pick(_SOURCES, F.col("p_size")), pick(_LEVELS, F.col("p_size")), F.col("p_name"), pick(_ABOUT, k), none, none, none, none]
    return frame(spark, RAW, RAW_ROWS).unionByName(read_table(spark, sf, "part").select(*[c.alias(n) for n, c in zip(RAW, own, strict=True)]))


def _rules(spark, sf):
    return rules.catalogue(spark, rules.normalise(_raw_rules(spark, sf)))


@query("rules_normalized", f"with {_NORM} select * from cat")
def rules_normalized(spark, sf):
    return _rules(spark, sf)


RES = ["rank", "resource_type", "cloud_provider", "category"]
RES_ROWS = [(1, "azurerm_storage_account", "azure", "storage"), (2, "kubernetes_pod", "kubernetes", "compute"), (3, "", "aws", ""), (4, "typed_thing",
    "generic", "secrets")]
_TYPES, _CLOUDS, _GROUPS = ["azurerm_storage_account", "kubernetes_pod", "", "AWS_s3_bucket"], ["aws", "Azure", "", "kubernetes", "gcp"], ["storage", "", "compute"]
_NATIONS = f"select 10 + n_nationkey, {pick_sql(_TYPES, 'n_nationkey')}, {pick_sql(_CLOUDS, 'n_nationkey')}, {pick_sql(_GROUPS, 'n_nationkey')} from nation"
_FIT = f"""f as (select s.*, r.rule_id, r.severity, r.resource_type as rule_type from {beside(RES, RES_ROWS, _NATIONS)} s join cat r on (lower(r.cloud_provider) = lower(coalesce(nullif(s.cloud_provider, ''), 'generic')) or lower(r.cloud_provider) in ('generic','all','unknown')) and ((s.resource_type <> '' and lower(r.resource_type) = lower(s.resource_type)) or lower(r.resource_type) = lower(coalesce(nullif(s.category, ''), 'general')) or (s.resource_type = '' and lower(r.resource_type) = 'general')))"""


def resources(spark, sf):
    """Fixed resources, and one for each nation."""
    n = F.col("n_nationkey")
    own = read_table(spark, sf, "nation").select((n + 10).cast("long").alias("rank"), pick(_TYPES, n).alias("resource_type"), pick(_CLOUDS, n).alias(
        "cloud_provider"), pick(_GROUPS, n).alias("category"))
    return frame(spark, RES, RES_ROWS).unionByName(own)


@query("rule_filter_join", f"with {_NORM}, {_FIT} select rank, rule_id, severity from f")
def rule_filter_join(spark, sf):
    return rules.applicable(resources(spark, sf), _rules(spark, sf)).select("rank", F.col("_r_rule_id").alias("rule_id"),
        F.col("_r_severity").alias("severity"))


@query("rule_aware_topk",
    f"""with {_NORM}, {_FIT}, s as (select rule_id, any_value(severity) as severity, max(round(case when lower(rule_type) = lower(resource_type) then 0.95 else 0.85 end + case when starts_with(rule_id, 'custom-') then 0.2 else 0 end, 6)::double) as score from f group by rule_id),
o as (select *, row_number() over (order by score desc, case severity when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 when 'LOW' then 3 when 'INFO' then 4 else 9 end, rule_id)::int as rank from s) select rule_id, severity, score, rank from o where rank <= 7""")
def rule_aware_topk(spark, sf):
    return rules.rule_aware(resources(spark, sf), _rules(spark, sf), 7)


@query("rule_lookup", f"with {_NORM} select rule_id, severity, title from cat where rule_id = 'gcp-01'")
def rule_lookup(spark, sf):
    return _rules(spark, sf).filter("rule_id = 'gcp-01'").select("rule_id", "severity", "title")


@query("rule_text_build",
    f"""with {_NORM} select rule_id, '[' || upper(category) || ' | ' || severity || ' | ' || cloud_provider || ' | ' || resource_type || '] ' || title || chr(10) || chr(10)
  || title || ' (' || resource_type || ', ' || cloud_provider || ').' || chr(10) || chr(10) || 'Indicators: Settings of ' || resource_type || ' that show: ' || lower(title) || chr(10) || chr(10)
  || 'Remediation: Change the ' || category || ' settings so that this no longer holds.' || chr(10) || chr(10) || 'References: ' as text from cat""")
def rule_text_build(spark, sf):
    return rules.rule_text(_rules(spark, sf))


@query("rule_vector_topk")
def rule_vector_topk(spark, sf):
    """Rules embedded by the offline encoder, ranked for a question."""
    from sparkseam.operators.store import embed

    docs = embed(rules.rule_text(_rules(spark, sf))).select("rule_id", "embedding")
    asked = embed(spark.range(1).select(F.lit("public storage bucket open to anonymous readers").alias("text"))).select("embedding").first()[0]
    return search.vector_topk(docs, list(asked), 7, "rule_id").select("rule_id", "score", "rank")


ISS = ["iid", "rule_id", "rule_description"]
ISS_ROWS = [(1, "", ""), (2, "own-1", ""), (3, "own-2", "said")]


_LABEL_ISS = "select 100 + doc_id, case when doc_id % 3 = 0 then '' else 'own-' || doc_id end, case when doc_id % 2 = 0 then '' else 'said' end from labels"


@query("issue_enrich", f"with {_NORM} select iid, coalesce(nullif(i.rule_id, ''), 'gcp-01') as rule_id, coalesce(nullif(rule_description, ''), "
    f"(select title from cat where rule_id = 'gcp-01')) as rule_description from {beside(ISS, ISS_ROWS, _LABEL_ISS)} i")
def issue_enrich(spark, sf):
    d = F.col("doc_id")
    own = read_table(spark, sf, "labels").select((d + 100).alias("iid"), F.when(d % 3 == 0, "").otherwise(F.concat(F.lit("own-"), d)).alias("rule_id"),
        F.when(d % 2 == 0, "").otherwise("said").alias("rule_description"))
    return rules.enrich(frame(spark, ISS, ISS_ROWS).unionByName(own), _rules(spark, sf).filter("rule_id = 'gcp-01'"))
