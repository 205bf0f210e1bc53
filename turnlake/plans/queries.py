"""The query catalogue: each operator over a proxy of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.functions import losses, render, seq
from turnlake.functions import text as T
from turnlake.llm.common import materialize
from turnlake.operators import assemble, bench, clean, integrity, metrics, reporting, training
from turnlake.plans import proxies
from turnlake.plans.proxies import table

R6 = lambda c: F.round(c, 6)


def _stats(spark, sf):
    return metrics.event_stats(proxies.events(spark, sf))


def q01_conv_zip(spark: SparkSession, sf: str) -> DataFrame:
    arrays = clean.to_arrays(table(spark, sf, "conversations"), "conv_id", "turn")
    return clean.conversation_rows(arrays).select("id", F.col("pos").cast("bigint").alias("pos"), "role", F.length("text").cast("bigint").alias("n_chars"))


def q02_norm_query(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.norm_query(F.concat(F.lit("Step "), F.col("conv_id").cast("string"), F.lit(":  "), F.col("text"), F.lit(" \n"))).alias("query"))


def q03_schema_convert(spark, sf):
    m = F.col("p_size") % 6
    t = (
        F.when(m == 0, F.lit("str")).when(m == 1, F.concat(F.lit("int, optional, default="), F.col("p_size").cast("string"))).when(m == 2, F.lit("List[float]"))
        .when(m == 3, F.concat(F.lit("str, optional, default '"), F.col("p_name"), F.lit("'"))).when(m == 4, F.lit("Dict")).otherwise(F.lit("bool, optional"))
    )
    p = table(spark, sf, "part").select("p_partkey", t.alias("t"), "p_name")
    p = p.withColumn("c", F.get(F.map_values(T.convert_flat_tool(F.create_map(F.lit("p"), F.struct(F.col("t").alias("type"), F.col("p_name").alias("description"), F.lit(None).cast("string").alias("default"))))), F.lit(0)))
    return p.select("p_partkey", F.col("c.type").alias("json_type"), F.col("c.description").alias("description"), F.col("c.default").alias("default_value"), F.col("c.required").alias("required"))


def q04_conv_filter(spark, sf):
    return clean.shape_reasons(table(spark, sf, "conversations"))


def q04b_funnel(spark, sf):
    return clean.funnel(clean.shape_reasons(table(spark, sf, "conversations")))


def q05_dedupe_first(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return clean.dedupe_first(d, T.collapse(F.col("text")), "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


def q05b_clean_stats(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    f = d.where("n_chars >= 200")
    return clean.clean_stats(d, f, clean.dedupe_first(f, T.collapse(F.col("text")), "doc_id"))


def _carve(spark, sf, n=100):
    return clean.rarity_carve(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("example"), F.col("l_partkey").alias("tool")), n)


def q06_rarity_carve(spark, sf):
    c = _carve(spark, sf)
    tag = lambda df, col, name: df.select(F.lit(name).alias("part"), F.col(col).alias("id"))
    return tag(c["eval"], "example", "eval").unionByName(tag(c["heldout"], "tool", "heldout")).unionByName(tag(c["pool"], "example", "pool"))


def q06b_tool_frequency(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return l.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_examples"))


def q07_seeded_sample(spark, sf):
    return clean.hash_sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 100)


def q07b_pool_minus(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return clean.pool_minus(d, clean.hash_sample(d, "doc_id", 100), "doc_id")


def q08_token_regions(spark, sf):
    """Whitespace tokens with offsets; a call span from the 10th to the 30th token, a tag on each side.
    Spans end with a text that is shorter; those that it does not reach are empty."""
    span = lambda o, a, b: F.array(F.struct(F.get(o, F.lit(a))["s"].alias("s"), F.coalesce(F.get(o, F.lit(b))["s"], F.get(o, F.size(o) - 1)["e"]).alias("e")))
    regions = lambda o: seq.regions_of(o, [(F.concat(span(o, 9, 10), span(o, 29, 31)), 3), (span(o, 10, 30), 2)])
    r = seq.let(seq.offsets(F.transform(proxies.words(), F.length)), regions)
    # an inner explode would add a filter that computes r once more
    d = table(spark, sf, "documents").select("doc_id", F.posexplode_outer(r).alias("pos", "region")).where("pos is not null")
    return d.groupBy("doc_id", "region").agg(F.count(F.lit(1)).alias("n"), F.min("pos").cast("bigint").alias("first"), F.max("pos").cast("bigint").alias("last"))


def _labels(spark, sf):
    """Conversation token labels: 3 tokens per turn, loss on assistant turns."""
    c = table(spark, sf, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    g = c.groupBy("conv_id").agg(turns.alias("t"))
    ids = F.flatten(F.transform("t", lambda x: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: (x["turn"] * 3 + j + 1).cast("int"))))
    labels = F.flatten(F.transform("t", lambda x: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: F.when(x["role"] == "assistant", (x["turn"] * 3 + j + 1).cast("int")).otherwise(F.lit(-100)))))
    return g.select("conv_id", ids.alias("input_ids"), labels.alias("labels"))


def q09_turn_starts(spark, sf):
    return _labels(spark, sf).select("conv_id", F.posexplode(seq.turn_starts(F.col("labels"))).alias("turn_index", "start")).select("conv_id", F.col("turn_index").cast("bigint").alias("turn_index"), F.col("start").cast("bigint").alias("start"))


def q10_rle(spark, sf):
    r = proxies.user_codes(spark, sf).select("query_id", F.posexplode(seq.rle(F.col("codes"))).alias("run", "r"))
    return r.select("query_id", F.col("run").cast("bigint").alias("run"), F.col("r.code").cast("bigint").alias("code"), F.col("r.len").cast("bigint").alias("len"))


def q10b_unrle(spark, sf):
    r = proxies.user_codes(spark, sf).select("query_id", F.posexplode(seq.unrle(seq.rle(F.col("codes")))).alias("pos", "code"))
    return r.select("query_id", F.col("pos").cast("bigint").alias("pos"), F.col("code").cast("bigint").alias("code"))


def q11_length_stats(spark, sf):
    return assemble.length_stats(table(spark, sf, "documents").select("lang", "n_chars"), "n_chars", "lang")


def q12_region_totals(spark, sf):
    t = assemble.region_totals(proxies.user_codes(spark, sf).select(seq.rle(F.col("codes")).alias("regions")))
    return t.select(F.col("code").cast("bigint").alias("code"), "n_tokens", "n_runs")


def q13_boundary_contexts(spark, sf):
    d = _labels(spark, sf)
    p = d.select("conv_id", F.posexplode(seq.turn_starts(F.col("labels"))).alias("t", "s"), "input_ids")
    p = p.withColumn("ids", F.slice("input_ids", F.lit(1), F.col("s"))).where(F.size("ids") > 0)
    p = p.withColumn("clip", seq.clip_left(F.col("ids"), 7, 4))
    return p.select(F.concat(F.col("conv_id").cast("string"), F.lit("#t"), F.col("t").cast("string")).alias("query_id"), F.size("ids").cast("bigint").alias("n"), F.size("clip").cast("bigint").alias("n_clip"), F.get("clip", F.lit(0)).cast("bigint").alias("first_kept"))


def q14_payload_spans(spark, sf):
    p = table(spark, sf, "pages").select("page_id", T.payload_spans(F.col("html"), "<p>", "</p>").alias("s"))
    p = p.select("page_id", F.posexplode("s").alias("i", "x"))
    return p.select("page_id", F.col("i").cast("bigint").alias("i"), F.col("x.s").cast("bigint").alias("s"), F.col("x.e").cast("bigint").alias("e"))


def q14b_outermost_spans(spark, sf):
    both = F.concat(T.payload_spans(F.col("html"), "<article>", "</article>"), T.payload_spans(F.col("html"), "<p>", "</p>"))
    p = table(spark, sf, "pages").select("page_id", F.explode(T.outermost(both)).alias("x"))
    return p.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("x.e") - F.col("x.s")).cast("bigint").alias("n_chars"))


def q14c_tag_counts(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.tag_count(F.col("html"), "<p>").cast("bigint").alias("n_open"), T.tag_count(F.col("html"), "</p>").cast("bigint").alias("n_close"))


def _logprobs(spark, sf):
    e = table(spark, sf, "embeddings").where("embedding is not null")
    return e.select("vec_id", F.transform("embedding", lambda v, i: F.struct(i.alias("id"), F.round(v.cast("double"), 2).alias("lp"))).alias("p"))


def q15_logprob_sort(spark, sf):
    s = _logprobs(spark, sf).select("vec_id", F.posexplode(F.slice(seq.sort_logprobs(F.col("p")), 1, 5)).alias("rank", "x"))
    return s.select("vec_id", F.col("rank").cast("bigint").alias("rank"), F.col("x.id").cast("bigint").alias("id"), F.col("x.lp").alias("lp"))


def q15b_with_eos(spark, sf):
    ids = F.when(F.col("k") % 3 == 0, F.array(F.col("k").cast("int"), F.lit(2))).otherwise(F.array(F.col("k").cast("int")))
    e = proxies.calls(spark, sf).select("event_id", seq.with_eos(ids, F.when(F.col("k") % 2 == 0, "stop").otherwise("length"), 2).alias("ids"))
    return e.select("event_id", F.size("ids").cast("bigint").alias("n"), F.element_at("ids", -1).cast("bigint").alias("last"))


def q16_join_report(spark, sf):
    return assemble.join_report(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), "doc_id")


def q16b_join_one_to_one(spark, sf):
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    d = d.join(l.select("doc_id"), "doc_id", "left_semi").select("doc_id", "n_chars")
    return assemble.join_one_to_one(d, l.select("doc_id", "quality"), "doc_id")


def _verdicts(spark, sf, need_call=True):
    c = proxies.calls(spark, sf)
    types = [x for x in proxies.TYPE_CODE]
    schema = F.struct(F.array(F.lit("city"), F.lit("unit")).alias("allowed"), F.array(F.lit("city")).alias("required"))
    schemas = F.create_map(*(y for t in types for y in (F.lit(t), schema)))
    payloads = F.transform(T.payload_spans(F.col("text"), "<call>", "</call>"), lambda x: F.substring(F.col("text"), x["s"] + 1, x["e"] - x["s"]))
    problems = T.validate(F.col("payloads"), schemas, need_call)
    v = c.select("event_id", payloads.alias("payloads")).select("event_id", F.size("payloads").cast("bigint").alias("n_calls"), problems.alias("problems"))
    return v.withColumn("valid", F.size("problems") == 0)


def q17_validate_calls(spark, sf):
    v = _verdicts(spark, sf)
    return v.select("event_id", "n_calls", "valid", F.size("problems").cast("bigint").alias("n_problems"), T.reason_key(F.get("problems", F.lit(0))).alias("first_reason"))


def q17b_validate_relaxed(spark, sf):
    return _verdicts(spark, sf, False).select("event_id", "valid")


def q18_drop_reasons(spark, sf):
    return assemble.drop_reasons(_verdicts(spark, sf))  # valid ones have no problems


def q18b_assembly_stats(spark, sf):
    return assemble.assembly_stats(_verdicts(spark, sf))


def q19_kd_record(spark, sf):
    c = proxies.calls(spark, sf)
    s = F.struct(F.lit(1).alias("s"), F.lit(3).alias("e"))
    none = F.expr("cast(array() as array<struct<s: int, e: int>>)")
    rows = c.select(
        F.col("event_id").cast("string").alias("query_id"), F.sequence(F.lit(1), (F.col("k") % 4 + 1).cast("int")).alias("prompt_ids"), F.sequence(F.lit(101), (F.lit(101) + F.col("k") % 6).cast("int")).alias("gen_ids"),
        F.array_repeat(F.lit(1), (F.col("k") % 6 + 1).cast("int")).alias("lengths"), F.array(s).alias("calls"), F.when(F.col("k") % 2 == 0, F.array(F.struct(F.lit(0).alias("s"), F.lit(1).alias("e")))).otherwise(none).alias("tags"),
        F.expr("cast(array(null) as array<array<struct<id: int, lp: double>>>)").alias("logprobs"),
    )
    r = assemble.kd_records(rows)
    return r.select("query_id", F.col("n_tokens").cast("bigint").alias("n_tokens"), F.size(F.filter("labels", lambda x: x != -100)).cast("bigint").alias("n_loss"), F.size("regions").cast("bigint").alias("n_runs"), F.get("regions", F.lit(-1) + F.size("regions"))["code"].cast("bigint").alias("last_region"))


def q20_event_stats(spark, sf):
    return _stats(spark, sf).select("event_id", "accepted", "scored", "bonus", "emitted")


def q21_flat_metrics(spark, sf):
    m = metrics.flat_metrics(_stats(spark, sf))
    return m.select("n_events", "n_prompts", R6("alpha").alias("alpha"), R6("tau").alias("tau"), R6("bonus_rate").alias("bonus_rate"), "tokens_emitted")


def q21b_first_step_alpha(spark, sf):
    return metrics.first_step_alpha(_stats(spark, sf)).withColumn("alpha0", R6("alpha0"))


def q22_alpha_by_position(spark, sf):
    return metrics.alpha_by_position(_stats(spark, sf), 5).select(F.col("pos").cast("bigint").alias("pos"), "pos_scored", "pos_accepted", R6("alpha_n").alias("alpha_n"))


def q23_phase_timing(spark, sf):
    t = metrics.phase_timing(proxies.events(spark, sf))
    return t.select("n_timed", *(F.round(c, 4).alias(c) for c in t.columns if c != "n_timed"))


def _placed(spark, sf):
    codes = proxies.user_codes(spark, sf)
    records = codes.select("query_id", seq.rle(F.col("codes")).alias("regions"), F.expr("cast(array() as array<int>)").alias("labels"), F.lit(3).alias("n_prompt_tokens"))
    return metrics.with_cursor(_stats(spark, sf), records)


def q24_region_metrics(spark, sf):
    return metrics.region_metrics(_placed(spark, sf)).select(F.col("region").cast("bigint").alias("region"), "n_verified", "n_accepted", "n_proposed", "n_emitted", R6("alpha").alias("alpha"))


def q25_per_prompt(spark, sf):
    return metrics.per_prompt(_stats(spark, sf)).withColumns({"alpha": R6("alpha"), "tau": R6("tau")})


def q26_bootstrap_ci(spark, sf):
    out = metrics.bootstrap_cis(metrics.per_prompt(_stats(spark, sf)), ["alpha", "tau"])
    return out.select("stat", R6("mean").alias("mean"), R6("lo").alias("lo"), R6("hi").alias("hi"), "n_prompts")


def q27_name_args_cut(spark, sf):
    c = proxies.calls(spark, sf)
    pieces = F.regexp_extract_all("call", F.lit(r"(?s)(.{1,4})"), F.lit(1))
    t = c.select(F.col("event_id").alias("span"), F.posexplode(pieces).alias("pos", "piece"))
    return metrics.name_arguments_cut(t).groupBy("span").agg(F.sum((F.col("sub") == 10).cast("bigint")).alias("n_name"), F.sum((F.col("sub") == 11).cast("bigint")).alias("n_args"))


def q28_ngram_lookup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.transform(proxies.words(), F.lower).alias("seq"))
    d = d.select("doc_id", seq.ngram_propose(F.col("seq"), F.lit(3), 3, 1, "<pad>").alias("p"))
    return d.select("doc_id", F.size("p").cast("bigint").alias("n"), F.array_join("p", " ").alias("proposal"))


def q29_integrity(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"))


def q29b_set_checks(spark, sf):
    c = _carve(spark, sf)
    uses = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("example"), F.col("l_partkey").alias("tool"))
    pool_tools = uses.join(c["pool"], "example", "left_semi")
    return integrity.set_checks(
        spark, disjoint=[("eval and pool", c["eval"], c["pool"], "example"), ("held-out and pool tools", c["heldout"], pool_tools, "tool")],
        subset=[("pool in all", c["pool"], uses, "example")], size=[("eval size", c["eval"], 100)], non_empty=[("held-out", c["heldout"])],
    )


def q30_mix_plan(spark, sf):
    return training.mix_plan(spark, 64, 0.25)


def q30b_context_mix(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "en", "multi").otherwise("single").alias("source"))
    return clean.mixed_contexts(d, "doc_id", "multi", 0.25)


def q31_pack(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.regexp_count("text", F.lit(r"[^ \t\n\r\f\x0b]+")).cast("bigint").alias("n"))
    return training.greedy_packs(d, 8192).select("ord", "n", "pack", "offset")


def q31b_pack_stats(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.regexp_count("text", F.lit(r"[^ \t\n\r\f\x0b]+")).cast("bigint").alias("n"))
    return training.pack_stats(training.greedy_packs(d, 1024), d.where("n > 1024"))


def q32_chunks(spark, sf):
    c = bench.chunked(table(spark, sf, "documents"), "doc_id", 32)
    return c.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"), F.col("chunk").cast("bigint").alias("chunk"), F.col("place").cast("bigint").alias("place"))


def _outputs(spark, sf, shift):
    d = table(spark, sf, "documents").select((F.col("doc_id") + shift).cast("string").alias("query_id"), proxies.words().alias("output_ids"))
    return d


def q33_first_divergence(spark, sf):
    a, b = _outputs(spark, sf, 0), _outputs(spark, sf, 1)
    both = a.select("query_id").join(b.select("query_id"), "query_id")
    e = bench.exactness(a.join(both, "query_id", "left_semi"), b.join(both, "query_id", "left_semi"))
    return e.select("query_id", F.col("first_divergence").cast("bigint").alias("first_divergence"), F.col("len_baseline").cast("bigint").alias("len_baseline"), F.col("len_spec").cast("bigint").alias("len_spec"))


def q33b_exactness_summary(spark, sf):
    d = table(spark, sf, "documents")
    firsts = d.select(F.col("doc_id").cast("string").alias("query_id"), proxies.words().alias("output_ids"))
    cut = firsts.withColumn("output_ids", F.when(F.col("query_id").cast("bigint") % 10 == 0, F.slice("output_ids", 1, 5)).otherwise(F.col("output_ids")))
    return bench.exactness_summary(bench.exactness(firsts, cut))


def q34_run_medians(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.col("value") + 1).alias("wall_s"), proxies.k_of(F.col("props")).alias("gen_tokens"), F.lit(12).alias("prompt_tokens"))
    m = bench.run_medians(e, "event_type")
    return m.select("event_type", "runs", *(R6(c).alias(c) for c in m.columns if c.startswith("median")))


def q35_latest_per_key(spark, sf):
    e = table(spark, sf, "events")
    return bench.latest_per_key(e, ["user_id", "event_type"], F.struct("ts", "event_id"), "event_id", "value")


def _by_method(spark, sf):
    e = table(spark, sf, "events").withColumn("method", F.when(F.col("event_type") == "view", "ar").otherwise(F.col("event_type")))
    return e.groupBy((F.col("user_id") % 3).alias("batch"), "method").agg((F.sum(proxies.k_of(F.col("props"))) / F.count(F.lit(1))).alias("tok_s"))


def q36_pick_best(spark, sf):
    s = bench.speedups(_by_method(spark, sf), ["batch"])
    return bench.pick_best(s.where("batch = 0"), "method").select("batch", "method", R6("speedup").alias("speedup"))


def q36b_speedup_estimate(spark, sf):
    p = metrics.per_prompt(_stats(spark, sf))
    return p.select("query_id", R6(bench.estimated_speedup(F.col("tau"), F.lit(1.5))).alias("speedup"))


def q36c_speedups(spark, sf):
    return bench.speedups(_by_method(spark, sf), ["batch"]).select("batch", "method", R6("tok_s").alias("tok_s"), R6("speedup").alias("speedup"))


def q37_jsonl_repair(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("junk\x1b[0m "), F.col("props")).alias("line"))
    return e.select("event_id", F.from_json(T.repair_json_line(F.col("line")), "k bigint")["k"].alias("k"))


def q38_config_grid(spark, sf):
    axis = lambda name, values: spark.createDataFrame([(v,) for v in values], name)
    g = bench.grid(m=axis("method string", ["ar", "ngram", "draft_model"]), k=axis("k int", [3, 5, 7]), t=axis("temperature double", [0.0, 0.7]))
    return g.select("method", F.col("k").cast("bigint").alias("k"), "temperature", bench.spec_config(F.col("method"), F.col("k"), F.lit("m/x"), F.lit(2), F.lit(4)).alias("config"))


def _logit_pairs(spark, sf):
    e = table(spark, sf, "embeddings").where("embedding is not null and size(embedding) = 64").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 8, 3)).alias("x"))
    return e.select("vec_id", F.col("x").alias("s")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("t")), "vec_id")


def q39_topk_kl(spark, sf):
    p = _logit_pairs(spark, sf)
    lp = losses.log_softmax(F.col("t"), 60)
    p = p.withColumn("teacher", F.slice(seq.sort_logprobs(F.transform(lp, lambda v, i: F.struct(i.alias("id"), v.alias("lp")))), 1, 20))
    return p.select("vec_id", R6(losses.topk_kl_row(F.col("s"), F.col("teacher"), (F.col("vec_id") % 60).cast("int"), 60, 0.1)).alias("loss"))


def q40_divergences(spark, sf):
    p = _logit_pairs(spark, sf)
    return p.select("vec_id", *(R6(losses.divergence_row(F.col("s"), F.col("t"), 60, d)).alias(d) for d in ("reverse_kl", "forward_kl", "jsd")))


def q41_verify_round(spark, sf):
    c = proxies.calls(spark, sf)
    ids = lambda base: F.transform(F.sequence(F.lit(1), (F.col("k") % 4 + 1).cast("int")), lambda i: ((base * i) % 5).cast("int"))
    proposal = ids(F.col("k"))
    preds = F.concat(ids(F.when(F.col("k") % 3 == 0, F.col("k")).otherwise(F.col("k") + 5 * (F.col("user_id") % 2) + (F.col("event_id") % 2))), F.array((F.col("event_id") % 5).cast("int")))
    r = c.select("event_id", seq.verify_round(proposal, preds, (1 + F.col("user_id") % 6).cast("int"), 4).alias("r"))
    return r.select("event_id", F.size("r.mask").cast("bigint").alias("n"), F.size(F.filter("r.mask", lambda x: x)).cast("bigint").alias("n_accepted"), F.col("r.correction").cast("bigint").alias("correction"), F.col("r.step_type").alias("step_type"), F.col("r.eos").alias("eos"))


def q42_round_loop(spark, sf):
    """Each text's last 64 words are proposed and verified after all its words before them."""
    none = F.expr("cast(array() as array<int>)")
    w = F.coalesce(F.transform(proxies.words(), lambda w: F.abs(F.xxhash64(F.lower(w)) % 50).cast("int") + 2), none)
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("query_id"), w.alias("w"))
    n = F.greatest(F.size("w") - 64, F.lit(0))
    rows = d.select("query_id", F.slice("w", F.lit(1), n).alias("prompt_ids"), F.slice("w", n + 1, F.lit(64)).alias("target_ids"))
    return training.simulate(rows, 5, 64, 1).select("query_id", "step", F.size("draft_tokens").alias("n"), F.size(F.filter("accept_mask", lambda x: x)).alias("n_accepted"), "step_type")


def q43_contamination(spark, sf):
    return clean.contamination(table(spark, sf, "benchmark"), table(spark, sf, "documents"))


def q43b_same_queries(spark, sf):
    key = T.collapse(F.col("text"))
    a, b = table(spark, sf, "documents").where("doc_id % 2 = 0").select(key.alias("q")).distinct(), table(spark, sf, "documents").where("doc_id % 2 = 1").select(key.alias("q")).distinct()
    return a.join(b, "q", "left_semi").agg(F.count(F.lit(1)).alias("n_shared"))


def q44_gold_classes(spark, sf):
    c = proxies.calls(spark, sf)
    gold = F.concat(F.lit('{"name": "'), F.col("event_type"), F.lit('", "arguments": {"city": "c'), F.col("k").cast("string"), F.lit('", "unit": "m"}}'))
    return assemble.gold_classes(c.select(F.when(F.col("k") % 7 == 4, F.lit("prose")).otherwise(F.col("call")).alias("generated"), gold.alias("gold")))


def q45_opener_distribution(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.get(proxies.words(), F.lit(0)).alias("first"))
    return assemble.opener_distribution(d, "lang")


def q46_ci_overlap(spark, sf):
    # the prompts of all types in one pass over the events
    prompts = materialize(metrics.per_prompt(_stats(spark, sf), "event_type"))
    parts = None
    for t in proxies.TYPE_CODE:
        ci = metrics.bootstrap_ci(prompts.where(F.col("event_type") == t), "tau").select(F.lit(t).alias("run"), "lo", "hi")
        parts = ci if parts is None else parts.unionByName(ci)
    return metrics.ci_overlap(parts)


def _rendered(spark, sf):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("m")).select("conv_id", render.render(F.col("m")).alias("text"))


def q47_render(spark, sf):
    return _rendered(spark, sf).select("conv_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"))


def q48_records(spark, sf):
    r = render.records(_rendered(spark, sf))
    loss = F.size(F.filter("labels", lambda x: x != -100))
    return r.select("conv_id", F.col("n_tokens").cast("bigint").alias("n_tokens"), loss.cast("bigint").alias("n_loss"), F.col("n_prompt_tokens").cast("bigint").alias("n_prompt_tokens"))


def q49_assistant_spans(spark, sf):
    s = _rendered(spark, sf).select("conv_id", F.posexplode(render.assistant_spans(F.col("text"))).alias("i", "x"))
    return s.select("conv_id", F.col("i").cast("bigint").alias("i"), F.col("x.s").cast("bigint").alias("s"), F.col("x.e").cast("bigint").alias("e"))


def q50_region_extremes(spark, sf):
    x = bench.region_extremes(metrics.region_metrics(_placed(spark, sf)))
    return x.select(*(R6(c).alias(c) for c in x.columns))


def q51_positions_improved(spark, sf):
    s = _stats(spark, sf)
    even = (F.col("query_id").cast("bigint") % 2) == 0
    return bench.positions_improved(metrics.alpha_by_position(s.where(even)), metrics.alpha_by_position(s.where(~even)))


def q52_worst_gate(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type").agg(F.sum((proxies.k_of(F.col("props")) % 2 == 0).cast("bigint")).alias("n_exact"))
    return bench.worst_gate(e, "event_type")


def q53_teacher_width(spark, sf):
    e = table(spark, sf, "events").select(F.array_repeat(F.lit(1), (proxies.k_of(F.col("props")) % 25).cast("int")).alias("teacher"))
    return training.teacher_width(e).select(F.col("width").cast("bigint").alias("width"))


def q54_cyclic_contexts(spark, sf):
    return training.cyclic(table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "nation").select("n_nationkey", "n_name"), "o_orderkey", "n_nationkey").select("o_orderkey", "n_name")


def q55_messages(spark, sf):
    """events as raw single-turn rows: a tool named by the type, one or two answers by k."""
    c = proxies.calls(spark, sf)
    tools = F.concat(F.lit('[{"name": "'), F.col("event_type"), F.lit('", "description": "d", "parameters": {"city": {"type": "str", "description": "c"}, "n": {"type": "int, optional", "description": "n", "default": 3}}}]'))
    answers = F.concat(F.lit("["), F.col("call"), F.when(F.col("k") % 2 == 1, F.concat(F.lit(", "), F.col("call"))).otherwise(F.lit("")), F.lit("]"))
    m = assemble.single_turn_messages(c.select(F.col("event_id").alias("id"), F.col("text").alias("query"), tools.alias("tools"), answers.alias("answers")))
    first = F.get("messages", F.lit(1))["tool_calls"]
    return m.select("query_id", F.col("n_answers").cast("bigint").alias("n_answers"), F.get(first, F.lit(0))["name"].alias("first_name"), F.get(first, F.lit(0))["arguments"].alias("first_arguments"), F.get("tools", F.lit(0))["parameters"]["n"]["default"].alias("default_n"), F.length(F.get("messages", F.lit(0))["content"]).cast("bigint").alias("n_query"))


def q55b_typed_messages(spark, sf):
    """events as raw single-turn rows with keys in both orders, repeated keys, numbers and defaults of all types."""
    c = proxies.calls(spark, sf).select("event_id", "event_type", "k")
    k = F.col("k").cast("string")
    args = F.when(F.col("k") % 3 == 0, F.concat(F.lit('{"z": '), k, F.lit(', "a": 2.0, "n": null}'))).when(F.col("k") % 3 == 1, F.concat(F.lit('{"a": "'), k, F.lit('", "z": [1.50, true]}'))).otherwise(F.concat(F.lit('{"z": 1, "a": NaN, "z": '), k, F.lit("}")))
    default = F.when(F.col("k") % 2 == 0, F.lit("3")).otherwise(F.lit('"3"'))
    tools = F.concat(F.lit('[{"name": "f", "parameters": {"n": {"type": "int", "default": '), default, F.lit('}, "m": {"type": "float, default=2.5"}}}]'))
    answers = F.concat(F.lit('[{"name": "'), F.col("event_type"), F.lit('", "arguments": '), args, F.lit("}]"))
    m = assemble.single_turn_messages(c.select(F.col("event_id").alias("id"), F.lit("q").alias("query"), tools.alias("tools"), answers.alias("answers")))
    p = F.get("tools", F.lit(0))["parameters"]
    return m.select("query_id", F.get(F.get("messages", F.lit(1))["tool_calls"], F.lit(0))["arguments"].alias("arguments"), p["n"]["default_json"].alias("default_n"), p["m"]["default_json"].alias("default_m"))


def q60_converted(spark, sf):
    """events as raw multi-turn conversations: a call with arguments of all kinds, its result, and an end; k decides
    what is wrong with them."""
    c = proxies.calls(spark, sf).select("event_id", "event_type", "k")
    k, kind = F.col("k").cast("string"), F.col("k") % 8
    args = (
        F.when(kind == 0, F.concat(F.lit("{'z': "), k, F.lit(", 'a': (1), 'b': (1,), 'c': None}"))).when(kind == 1, F.concat(F.lit('{"z": 1.0, "a": "'), k, F.lit('", "z": 2} so'))).when(kind == 2, F.lit("{broken"))
        .otherwise(F.lit("{}"))
    )
    name = F.when(kind == 3, "other").when(kind == 4, "Finish").otherwise(F.col("event_type"))
    final = F.when(kind == 5, F.lit('{"return_type": "give_up"}')).when(kind == 6, F.lit('{"return_type": "give_answer", "final_answer": 5}')).otherwise(F.concat(F.lit('{"return_type": "give_answer", "final_answer": "is '), k, F.lit('"}')))
    apis = F.concat(F.lit("You may use APIs: [{'name': '"), F.col("event_type"), F.lit("', 'parameters': {'properties': {'z': {'type': 'integer', 'enum': [1, 2.0], 'example_value': 1}}, 'required': ['z', 'y']}}, {'name': 'Finish'}]"))
    value = F.array(apis, F.lit("ask\nBegin!\n"), F.concat(F.lit("Thought: try\nAction: "), name, F.lit("\nAction Input: "), args), F.lit("found"), F.concat(F.lit("Thought: done\nAction: Finish\nAction Input: "), final))
    raw = c.select(F.concat(F.lit("Step 1: event "), F.col("event_id").cast("string")).alias("id"), F.struct(F.array(*map(F.lit, ("system", "user", "assistant", "function", "assistant"))).alias("from"), value.alias("value")).alias("conversations"))
    m = clean.converted(raw)
    at = lambda i: F.get("messages", F.lit(i))
    return m.select(
        "id", "reason", F.get(at(1)["tool_calls"], F.lit(0))["arguments"].alias("arguments"), at(0)["content"].alias("first"), at(2)["name"].alias("answers_to"), at(3)["content"].alias("final"),
        F.get("tools", F.lit(0)).alias("tool"), F.size("tools").cast("bigint").alias("n_tools"), "meta.query",
    )


def q56_dataset_stats(spark, sf):
    codes = proxies.user_codes(spark, sf)
    s = reporting.dataset_stats(codes.select(F.size("codes").alias("n_tokens"), seq.rle(F.col("codes")).alias("regions")))
    return s.select("n", "tokens_total", "n_tokens_median", "n_tokens_p95", "n_tokens_max", "pct_tool_call")


def q57_carve_stats(spark, sf):
    uses = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("example"), F.col("l_partkey").alias("tool"))
    return reporting.carve_stats(clean.rarity_carve(uses, 100), uses)


def q58_gather(spark, sf):
    """Every third document of the index of long ones, dereferenced and gathered."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("raw_idx"), "n_chars")
    index = bench.chunked(d.where("n_chars >= 500").select("raw_idx"), "raw_idx", 1 << 62).select(F.col("place").alias("ord"), "raw_idx")
    positions = index.where("ord % 3 = 0").select("ord", F.col("ord").alias("idx"))
    return reporting.gather(d, reporting.dereference(positions, index)).select(F.col("ord").cast("bigint").alias("ord"), "raw_idx", "n_chars")


def q59_run_totals(spark, sf):
    d = table(spark, sf, "documents").select(F.coalesce(proxies.words(), F.expr("cast(array() as array<string>)")).alias("output_ids"))
    return reporting.run_totals(d, 1.5).withColumn("wall_s", F.col("wall_s").cast("double"))


def q61_teacher_packs(spark, sf):
    """Records of whole texts with teacher rows, packed and padded to rectangles."""
    n_prompt = (F.col("doc_id") % 3 + 1).cast("int")
    words = F.coalesce(proxies.words(), F.expr("cast(array() as array<string>)"))
    d = table(spark, sf, "documents").select("doc_id", (n_prompt + F.size(words)).alias("n"), F.transform(words, F.length).alias("lengths"))
    row = lambda n, i: F.slice(F.array(*(F.struct((n + j).alias("id"), F.lit(-j - 1.0).alias("lp")) for j in range(3))), 1, (n + i) % 4)
    none = F.expr("cast(array() as array<struct<s: int, e: int>>)")
    # Records are built where their pack is: what is shuffled are lengths, not teacher rows. Dealt by
    # number: the lengths are small, so that Spark would put them in few tasks, but the rows are not.
    at = training.greedy_packs(d, 8192, "doc_id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "pack")
    rows = at.select(F.col("doc_id").alias("query_id"), F.array_repeat(F.lit(7), n_prompt).alias("prompt_ids"), F.col("lengths").alias("gen_ids"), "lengths", none.alias("calls"), none.alias("tags"), F.transform("lengths", row).alias("logprobs"), F.col("doc_id").alias("ord"), "pack", "offset")
    records = reporting.teacher_rows(assemble.kd_records(rows, "ord", "pack", "offset"))
    packs = training.pack_arrays(records)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    b = reporting.batch_arrays(packs, 2, "n_records", "position_ids").withColumns({"n_records": F.col("n_records").cast("bigint"), "n_tokens": F.size("position_ids").cast("bigint"), "positions": total("position_ids")})
    finite = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + F.when(x > float("-inf"), x.cast("bigint")).otherwise(0))
    return b.select("pack", "n_records", "n_tokens", "positions", F.size("labels").cast("bigint").alias("n_labels"), total("labels").alias("labels"), total("keep").alias("keep"), F.size(F.filter("valid", lambda v: v)).cast("bigint").alias("n_valid"),
                    total(F.flatten("teacher_ids")).alias("teacher_ids"), finite(F.flatten("teacher_lps")).alias("teacher_lps"), F.size(F.flatten("teacher_ids")).cast("bigint").alias("n_cells"))


def q62_keep_exact(spark, sf):
    """Token texts aligned with what they spell; those that tokenise to themselves and are valid stay."""
    t = _rendered(spark, sf).select("conv_id", F.when(F.col("conv_id") % 2 == 0, render.tokens(F.col("text"))).otherwise(F.regexp_extract_all("text", F.lit(r"(?s)(.{1,4})"), F.lit(1))).alias("pieces"))
    v = render.aligned(t).withColumn("valid", F.length("text") % 5 != 0)
    starts = F.aggregate("offsets", F.lit(0).cast("bigint"), lambda a, o: a + o["s"])
    return reporting.keep_exact(v).select("conv_id", F.size("pieces").cast("bigint").alias("n_pieces"), starts.alias("starts"), F.length("text").cast("bigint").alias("n_chars"))


def catalogue() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("q") and k[1:3].isdigit()}
