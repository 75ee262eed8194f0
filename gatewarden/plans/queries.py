"""The queries: (spark, sf_dir) to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatewarden.functions import arrow
from gatewarden.functions import text as X
from gatewarden.functions.arrow import NormaliserConfig
from gatewarden.operators import dashboard, evaluate, inference, retrieve, signatures, structure, vocabulary
from gatewarden.sources import writers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as requests: the method by page_id, no body."""
    method = F.when(F.col("page_id") % 3 == 0, "GET").when(F.col("page_id") % 3 == 1, "POST").otherwise("HEAD")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), method.alias("method"), "url", F.lit("").alias("body"))


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url")
    return rows.withColumn("identifier", structure.identifier(F.lit("GET"), F.col("url")))


def structure_identifier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identified(spark, sf_dir).groupBy("identifier").agg(F.count("*").alias("requests"))


def param_values_by_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure.parameters(_identified(spark, sf_dir).withColumn("body", F.lit(None).cast("string")))
    return rows.groupBy("param").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("value")), ",").alias("distinct_values"))


def unknown_structure_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _identified(spark, sf_dir)
    known = rows.filter("page_id % 2 = 0").select("identifier").distinct().withColumn("known", F.lit(True))
    verdict = F.when(F.col("known"), "known").otherwise("unknown_structure")
    return rows.join(known, "identifier", "left").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def msu_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = X.http_parts(F.col("method"), F.col("url"), F.col("body"))
    return page_requests(spark, sf_dir).select("id", F.array_join(parts, " | ").alias("parts"), F.size(parts).cast("long").alias("n"))


def msu_parts_whole_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = X.http_parts(F.col("method"), F.col("url"), F.col("body"), whole_path=True)
    return page_requests(spark, sf_dir).select("id", F.array_join(parts, " | ").alias("parts"), F.size(parts).cast("long").alias("n"))


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^a-z0-9_]+"), lambda x: x != "")


def word_tokens_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[,;+/=&':? \t\r\n\f\x0b]+")).alias("token"))
    return rows.filter("token <> ''").groupBy("token").agg(F.count("*").alias("n")).filter("n >= 20")


def token_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = NormaliserConfig(hex_pattern="^[0-9a-f]{8,}$", base_pattern="^[0-9]+$")
    counts = vocabulary.token_counts(table(spark, sf_dir, "documents").select(_words(F.col("text")).alias("tokens")), config)
    return counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("distinct_tokens"))


def _vocabulary(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.explode(_words(F.col("text"))).alias("token"))
    return vocabulary.vocabulary_ids(rows.groupBy("token").agg(F.count("*").alias("n")), size)


def vocab_topk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir, 500)


def sequence_encode_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", _words(F.col("text")).alias("tokens"))
    out = vocabulary.encoded(rows, _vocabulary(spark, sf_dir, 500), 16, "doc_id")
    return out.select("doc_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


def sequence_counts_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as sequences in which words of over 4 letters are placeholders; the contents are their languages."""
    toks = F.transform(_words(F.col("text")), lambda w: F.when(F.length(w) > 4, "__other__").otherwise(w))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_join(vocabulary.without_repeats(toks), " ").alias("seq"), F.col("lang").alias("content"))
    out = vocabulary.sequence_table(rows, "doc_id")
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("seq", "n", join(F.col("ids")).alias("ids"), join(F.col("samples")).alias("samples"))


def value_shape_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[ \t\r\n\f\x0b]+")).alias("token")).filter("token <> ''")
    return rows.groupBy(X.value_shape(F.col("token")).alias("shape")).agg(F.count("*").alias("n"))


def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.label_histogram(table(spark, sf_dir, "embeddings")).withColumn("name", X.label_name(F.col("label")))


def methods_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.method_counts(page_requests(spark, sf_dir))


def merge_vocab_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    of = lambda which: docs.filter(which).select(F.explode(_words(F.col("text"))).alias("token")).distinct()
    own = F.coalesce(F.col("lang"), F.lit(""))
    return vocabulary.merged_vocabularies(of(own == "en"), of(own == "de"), of(~own.isin("en", "de")))


def embedding_merge_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vocabulary.merged_embeddings(rows.filter("id % 3 <> 0"), rows).select("word", "id")


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = table(spark, sf_dir, "embeddings")
    queries = store.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieve.nearest(queries, store)


def knn_top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    votes = retrieve.voted(_neighbours(spark, sf_dir).filter("vec_id <> query_id"), store)
    return votes.join(store.select(F.col("vec_id").alias("query_id"), F.col("label").alias("y_true")), "query_id").withColumnRenamed("predicted", "y_pred")


def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _votes(spark, sf_dir).select("query_id", "y_true", "y_pred")


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_predicted(spark, sf_dir))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of embeddings against a shifted copy: every fifth is predicted as the next label, every seventh as an error."""
    y = F.col("label")
    p = F.when(F.col("vec_id") % 7 == 0, 10).when(F.col("vec_id") % 5 == 0, (y + 1) % 10).otherwise(y)
    return table(spark, sf_dir, "embeddings").select(y.alias("y_true"), p.cast("int").alias("y_pred"))


def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.report(_predicted(spark, sf_dir))


def binary_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.binary(_predicted(spark, sf_dir))


def attack_label_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    names = F.array(*[F.lit(x) for x in (*X.LABELS, "no idea", "resource leak")])
    answer = F.concat(F.col("text"), F.lit(" Final Classification: "), F.get(names, F.pmod(F.col("conv_id") + F.col("turn"), F.lit(12)).cast("int")))
    rows = turns.select("conv_id", "turn", answer.alias("response"))
    return evaluate.analysed(rows).select("conv_id", "turn", "y_pred", "prediction_result")


def final_answer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.col("role"), F.lit(" Final Answer: x Final Answer: "), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.after_last(answer, "Final Answer:").alias("answer"))


def prompt_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = F.when(F.col("turn") % 2 == 0, F.concat(F.col("role"), F.lit("\n# Input request\n"), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.split_prompt(prompt).alias("p")).select("conv_id", "turn", F.length("p.system").cast("long").alias("system_chars"), F.sha2("p.user", 256).alias("user_sha256"))


def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of documents stand for tokens."""
    return evaluate.length_histogram(table(spark, sf_dir, "documents").select(F.length("text").alias("n_len")), "n_len").select("bin", "n")


def length_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.length_stats(table(spark, sf_dir, "conversations").select(F.length("text").cast("long").alias("n")), "n")


def _denied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_type = 'error'")


def error_rate_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.counted(_denied(spark, sf_dir), "ts", 3_600)


def error_rate_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.counted(_denied(spark, sf_dir), "ts", 10, fill=False)


def adaptive_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.adaptive(table(spark, sf_dir, "events"), "ts")


def dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.date_trunc("hour", "ts").alias("hour"), "event_type", "event_id", "ts")
    return dashboard.keep_last(rows, ["user_id", "hour", "event_type"], [F.col("ts"), F.col("event_id")])


def row_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type")
    return dashboard.distinct_by_hash(rows, ["user_id", "event_type"]).select("row_hash")


def attack_type_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.top_counts(table(spark, sf_dir, "events"), "event_type", 3)


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.totals(table(spark, sf_dir, "events"), F.col("event_type") == "error")


def paged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dashboard.searched(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], "version 3")
    return dashboard.page(rows, 1, [F.col("doc_id")], 5).select("doc_id", F.col("place").cast("long").alias("place"))


def retention_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.retained(table(spark, sf_dir, "events"), "ts").groupBy("event_type").agg(F.count("*").alias("n"))


def props_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1).cast("long"))
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


def status_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", 403).when(F.col("event_type") == "view", 500).when(F.col("event_type") != "click", 200)
    label = (F.col("user_id") % 10).cast("int")
    rows = table(spark, sf_dir, "events").select(dashboard.verdict_of(status, label).alias("verdict"), dashboard.binarised(label).alias("label"))
    return rows.groupBy("verdict", "label").agg(F.count("*").alias("n"))


def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_requests(spark, sf_dir)
    m, u, b = F.col("method"), F.col("url"), F.col("body")
    return rows.select("id", X.prompt(m, u, b).alias("prompt"), X.request_lines(m, u, b).alias("lines"), X.request_content(u, b).alias("content"), X.raw_request(m, u, b).alias("raw"))


def url_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.url_parts(F.col("url")).alias("u")).select("page_id", "u.scheme", "u.netloc", "u.path", "u.query", "u.fragment")


def url_word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word tokens of request URLs, by position."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(X.word_tokens(F.col("url"))).alias("pos", "token"))
    return rows.groupBy("token").agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first_pos"))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of all pages, in whole, stand for payloads."""
    return table(spark, sf_dir, "pages").filter("url <> ''").select(F.col("page_id").alias("idx"), F.col("url").alias("text"))


def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.similar_pairs(_payloads(spark, sf_dir)).select("i", "j", F.col("d").cast("long").alias("d"))


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.similar_clusters(_payloads(spark, sf_dir))


def cluster_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir).select("idx", "cluster")


def cluster_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.size_histogram(_clusters(spark, sf_dir).groupBy("cluster").agg(F.count("*").alias("size"))).select("bin", "n")


def signature_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signatures.bucketed(signatures.signatures(_clusters(spark, sf_dir))).filter("NOT is_short")
    return signatures.rules(found, F.array_join("types", ", "), [F.col("size"), F.col("cluster")])


def containment_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.col("text").alias("s"))
    halves = rows.union(rows.select(F.substring("s", 5, 40)))
    return signatures.contained(halves, "s")


def hmm_anomaly_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_requests(spark, sf_dir).withColumns({"method": F.lit("GET"), "label": (F.col("id") % 11 == 0).cast("int")})
    # Hosts' pages all differ in path, so the path is cut to the language folder to give structures of many requests.
    rows = rows.withColumn("url", F.regexp_replace("url", r"(://[^/]*/[a-z]*)/[^?#]*", "$1"))
    models = structure.train(rows)
    found = structure.detect(rows, models)
    return found.groupBy("identifier", "verdict").agg(F.count("*").alias("n"))


def stage_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of the users' turns, of which an earlier run has completed the even conversations."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("request"))
    done = turns.filter("conv_id % 2 = 0").select("conv_id", "turn", F.lit(inference.COMPLETED).alias("state"))
    left = turns.withColumn("key", F.struct("conv_id", "turn"))
    return inference.remaining(left, done.withColumn("key", F.struct("conv_id", "turn")), "key").select("conv_id", "turn")


def two_stage_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs, every fourth with a payload, through both stages with a client that answers by rule."""
    payload = F.when(F.col("id") % 4 == 0, F.concat(F.col("url"), F.lit("' or 1=1"))).when(F.col("id") % 4 == 1, F.concat(F.col("url"), F.lit("/../../etc"))).otherwise(F.regexp_replace("url", "'", ""))
    tasks = page_requests(spark, sf_dir).select(F.col("id").alias("task_id"), payload.alias("request"), F.lit(None).cast("string").alias("response"), F.lit("ready").alias("state"))
    store = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"), F.col("text").alias("page_content"), F.lit("others").alias("attack_category"))
    store = inference.embedded(store, "page_content", inference.hash_encoder)
    out = inference.two_stage(tasks, inference.echo_client, inference.hash_encoder, store)
    return out.groupBy("attack_type").agg(F.count("*").alias("n"))


def stream_vs_batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a file stream to completion, counted by type and day."""
    import uuid

    schema = table(spark, sf_dir, "events").schema
    name = f"counts_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    counts = stream.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    q = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).filter("r = 1").select("user_id", "event_id")


def _joined(c: Column, by: str = " ") -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), by)


def request_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = X.parse_head(F.concat(F.lit(" "), "method", F.lit("  "), "url", F.lit(" HTTP/1.1")))
    return page_requests(spark, sf_dir).select("id", head.alias("h")).select("id", "h.method", "h.url")


def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.canonical_url(F.col("url")).alias("url"))


def body_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as forms, multipart bodies and plain ones."""
    body = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("k1.x="), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("-" * 29), "text")).otherwise(F.concat(F.lit("? "), "text"))
    rows = table(spark, sf_dir, "conversations").select(X.is_form(body).alias("form"), X.is_multipart(body).alias("multipart"), X.is_parameter_name(F.concat("role", F.when(F.col("turn") % 2 == 0, " x").otherwise("_x"))).alias("named"))
    return rows.groupBy("form", "multipart", "named").agg(F.count("*").alias("n"))


def _doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _words(F.col("text")).alias("tokens"))


def vocabulary_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.vocabulary(vocabulary.token_counts(_doc_tokens(spark, sf_dir)), 20, 3)


def placeholder_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _doc_tokens(spark, sf_dir)
    known = vocabulary.token_counts(rows).filter("n >= 50").select("token").distinct()
    return vocabulary.placeholders(rows, known, key="doc_id").select("doc_id", F.sha2("seq", 256).alias("seq_sha256"))


def sequence_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.sequence_vocabulary(table(spark, sf_dir, "conversations").select(F.array_join(_words(F.col("text")), " ").alias("seq")))


def first_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = X.first_pairs(X.query_pairs(F.concat(X.url_parts(F.col("url"))["query"], F.lit("&page=9&z=1&z=2"))))
    shown = F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"]))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(shown, "&").alias("pairs"))


def json_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as POST requests with JSON bodies."""
    rows = table(spark, sf_dir, "events").select(F.lit("post").alias("method"), F.concat(F.lit("/api/"), "event_type").alias("url"), F.col("props").alias("body"), F.create_map(F.lit("Content-Type"), F.lit("application/json")).alias("headers"))
    return structure.identified(rows, json=True).groupBy("identifier").agg(F.count("*").alias("n"))


def json_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.lit("/a?q=1").alias("url"), F.col("props").alias("body"))
    return structure.parameters(rows, json=True).groupBy("param", "value").agg(F.count("*").alias("n"))


def shape_code_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", _joined(X.shape_codes(F.col("url"))).alias("codes"))


def character_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(X.characters(F.col("text"))).alias("c")).groupBy(F.hex("c").alias("c")).agg(F.count("*").alias("n"))


def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.concat(F.lit('"\x01 '), F.col("text"), F.lit(' \t\x7f"'))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(X.clean_string(noisy), 256).alias("string_sha256"), F.sha2(X.clean_line(noisy), 256).alias("line_sha256"))


def filled_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = X.filled(F.lit("{role} says: {text} ({role}, {other})"), role=F.col("role"), text=F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(prompt, 256).alias("prompt_sha256"))


def escaped_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.regex_escape(F.concat(F.lit("(.*) "), "url")).alias("pattern"))


def signature_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    signature = X.signature_of(F.concat("url", F.lit(' "x%41  y"\\')))
    return table(spark, sf_dir, "pages").select("page_id", signature.alias("signature"), X.signature_length(signature).cast("long").alias("n"))


def aligned_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = X.aligned(X.http_parts(F.col("method"), F.col("url"), F.col("body")))
    return page_requests(spark, sf_dir).select("id", F.size(parts).cast("long").alias("parts"), F.array_join(X.all_tokens(parts), " ").alias("tokens"))


def aligned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = X.aligned(X.http_parts(F.col("method"), F.col("url"), F.col("body")), X.word_tokens)
    return page_requests(spark, sf_dir).select("id", F.array_join(X.all_tokens(parts), " ").alias("tokens"))


def parts_with_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = F.concat(F.lit("Host: h\n \nX-Id: "), F.col("id").cast("string"))
    parts = X.http_parts(F.col("method"), F.col("url"), F.lit("a=1&b=2"), headers=headers)
    return page_requests(spark, sf_dir).select("id", F.array_join(parts, " | ").alias("parts"))


def custom_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit(" { role: "), "role", F.lit(" , turn:"), F.col("turn").cast("string"), F.lit(" } "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.custom_body(body), "|").alias("parts"))


def identifier_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    identifier = F.concat(F.lit("GET|"), F.col("url"))
    code = X.encode_identifier(identifier)
    return table(spark, sf_dir, "pages").select("page_id", code.alias("code"), X.decode_identifier(code).alias("identifier"))


def event_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lag = X.lag_of(F.col("event_id") % 100, F.col("user_id") % 60 - 5)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(lag).cast("long").alias("lag"), F.round(F.avg(X.sigmoid(F.col("value") / 100)), 6).alias("mean"))


def union_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Denied requests and finished analyses, by the hour."""
    events = table(spark, sf_dir, "events").withColumn("end", F.when(F.col("user_id") % 3 != 0, F.col("ts")))
    both = dashboard.times_of((events.filter("event_type = 'error'"), "ts"), (events.filter("event_type = 'view'"), "end"))
    return dashboard.counted(both, "ts", 3_600)


def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return evaluate.by_position(rows.select("vec_id"), rows.select(F.col("label").alias("y"), F.col("vec_id").alias("other")), [F.col("vec_id")], [F.desc("other")])


def reportable_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter(writers.is_reportable(F.col("label"))).groupBy("label").agg(F.count("*").alias("n"))


def _page_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select((F.col("page_id") % 25).alias("cluster"), F.col("page_id").alias("idx"), F.col("url").alias("text"))


def clusters_without_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.without_outlier(_page_clusters(spark, sf_dir)).select("cluster", "idx")


def cluster_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _page_clusters(spark, sf_dir)
    return signatures.representative(rows, signatures.distance_sums(rows))


def rule_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.concat(F.lit("Types: Query:p"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ", Body:a$b").otherwise(""), F.lit(", Path, Body:id, others"))
    return table(spark, sf_dir, "pages").select("page_id", signatures.rule_targets(types).alias("targets"))


def list_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-worker lists of a user's event ids, merged in the order of the workers."""
    rows = table(spark, sf_dir, "events")
    part = lambda k: rows.filter(F.col("event_id") % 3 == k).groupBy(F.col("user_id").alias("key")).agg(F.array_sort(F.collect_list("event_id")).alias("values"))
    return vocabulary.merged_lists(part(0), part(1), part(2)).select("key", _joined(F.col("values"), ",").alias("ids"))


def _by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs, every fourth with a payload, as tasks of a client that answers by rule."""
    u = F.col("url")
    payload = F.when(F.col("id") % 4 == 0, F.concat(u, F.lit("' or 1=1"))).when(F.col("id") % 4 == 1, F.concat(u, F.lit("/../../etc"))).when(F.col("id") % 4 == 2, F.concat(u, F.lit("<b>"))).otherwise(u)
    return page_requests(spark, sf_dir).select(F.col("id").alias("task_id"), payload.alias("request"), F.lit(None).cast("string").alias("response"), F.lit("ready").alias("state"))


def direct_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.direct(_by_rule(spark, sf_dir), inference.echo_client).select("task_id", "state", "y_pred", "attack_type")


def one_stage_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"), F.col("text").alias("page_content"), F.lit("others").alias("attack_category"))
    store = inference.embedded(store, "page_content", inference.hash_encoder)
    out = inference.one_stage(_by_rule(spark, sf_dir), inference.echo_client, inference.hash_encoder, store)
    return out.select("task_id", "state", "y_pred", "attack_type")


def realtime_attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inference.realtime_results(_predicted(spark, sf_dir))
    return out.groupBy("y_pred").agg(F.count("*").alias("n"))


def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = inference.chat_prompt(F.col("role"), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(prompt, 256).alias("prompt_sha256"))


def message_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("request", F.struct(F.col("role").alias("system"), F.col("text").alias("user")))
    length = inference.input_length(F.col("request.system"), F.col("request.user")).cast("long")
    return rows.select("conv_id", "turn", F.sha2(inference.message_input(rows), 256).alias("input_sha256"), length.alias("n"))


def turn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a tokenizer that takes runs of letters for tokens."""
    import re

    letters = re.compile("[A-Za-z]+")
    rows = inference.with_tokens(table(spark, sf_dir, "conversations"), "text", lambda texts: [len(letters.findall(t)) for t in texts])
    return evaluate.length_stats(rows.select(F.col("n_tokens").alias("n")), "n")


def abnormal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as tasks, every other one finished, every third without a finding."""
    state = F.when(F.col("turn") % 2 == 0, inference.COMPLETED).otherwise(inference.READY)
    found = F.when(F.col("conv_id") % 3 != 0, F.col("text")).otherwise("  ")
    tasks = table(spark, sf_dir, "conversations").select("conv_id", "turn", state.alias("state"), found.alias("predicted_malicious"))
    return signatures.abnormal_parts(tasks).select("conv_id", "turn", F.sha2("text", 256).alias("text_sha256"), "type")


def task_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' URLs of four tasks, clustered at once."""
    rows = _payloads(spark, sf_dir).withColumn("task", F.col("idx") % 4)
    return signatures.similar_clusters(rows, within="task").select("task", "idx", "cluster")


def detection_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("event_type") == "error", "attack").when(F.col("event_type") == "click", "unknown_structure").otherwise("normal")
    return structure.counters(table(spark, sf_dir, "events").select(verdict.alias("verdict"), (F.col("user_id") % 3).alias("label")))


def least_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as topics: of each the partition that is least behind."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("topic"), (F.col("user_id") % 5).alias("partition"))
    return dashboard.router_lags(rows.agg(F.max("event_id").alias("high"), (F.min("event_id") - 7).alias("committed")))


def outgoing_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as messages to the partition that is least behind."""
    from gatewarden.streaming import stages

    rows = table(spark, sf_dir, "events").filter("event_type = 'error'")
    out = stages.outgoing(rows, "error", F.col("props"), F.col("event_id").cast("string"), least_lag(spark, sf_dir))
    return out.select("topic", "key", "value", "partition")


def time_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", X.iso(F.col("ts")).alias("iso"), X.iso(F.col("ts"), "yyyy-MM-dd HH:mm:ss").alias("shown"))


def rate_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.axis_bound(error_rate_tumbling(spark, sf_dir)).select(F.round("bound", 6).alias("bound"))


def unescaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = arrow.unescaped(F.concat(F.lit("\\u0041\\u00e9\\u00zz"), "text", F.lit("\\u4F60")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(body, 256).alias("body_sha256"))


def unquoted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = arrow.unquoted_fully(F.concat(F.lit("%252541+"), "url", F.lit("%2525252B")))
    return table(spark, sf_dir, "pages").select("page_id", part.alias("part"))
