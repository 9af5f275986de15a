"""Label joins, metrics, calibration and model queries."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import functions as F

from wiretide.config import DetectionConfig
from wiretide.fixtures import ctes, view
from wiretide.models import evaluation as ev
from wiretide.models import forest
from wiretide.operators.chain import materialize
from wiretide.operators.detection import opinion
from wiretide.operators.features import fill_defaults, flow_features, with_flow_vector, with_host_vector
from wiretide.operators.detectors import beaconing, exfiltration
from wiretide.operators.flows import flows
from wiretide.operators.windows import candidate_hosts
from wiretide.plans import analytics, detection, training
from wiretide.registry import query
from wiretide.registry.alerts import chain_sql, four_rules
from wiretide.registry.flows import BEACON_SQL, EXFIL_SQL, SHORT_ACTIVE, flow_ctes
from wiretide.registry.windows import _CANDIDATE, _FLOOD_SQL, _HOSTS, _SCAN_SQL, BOTH, LOW_FLOOD, LOW_SCAN, host_rows, packets

SCORES = ctes("v_scores")


def scores(spark, sf_dir):
    return view(spark, sf_dir, "v_scores")


def labelled_flows(spark, sf_dir):
    rows = flow_features(flows(packets(spark, sf_dir), SHORT_ACTIVE, splt=False))
    return ev.label_flows(rows, view(spark, sf_dir, "v_flow_labels"))


_FLOW_LABELS = flow_ctes(30_000_000, ("v_packets", "v_flow_labels")) + """,
lf as (select ff.*, cls label from ff join v_flow_labels using (src_ip, dst_ip, src_port, dst_port, protocol))"""


@query("flow_label_join", _FLOW_LABELS + "select flow_id, flow_start_us, label from lf")
def flow_label_join(spark, sf_dir):
    return labelled_flows(spark, sf_dir).select("flow_id", "flow_start_us", "label")


@query("label_counts", _FLOW_LABELS + "select label, count(*) n from lf group by label")
def label_counts(spark, sf_dir):
    return ev.class_counts(labelled_flows(spark, sf_dir))


@query("balanced_weights", _FLOW_LABELS + """
select label, round((select count(*) from lf) / ((select count(distinct label) from lf) * count(*)), 6) weight, count(*) n from lf group by label""")
def balanced_weights(spark, sf_dir):
    rows = forest.with_balanced_weights(labelled_flows(spark, sf_dir).select("label"))
    return rows.groupBy("label", F.round("weight", 6).alias("weight")).agg(F.count("*").alias("n"))


_HOST_LABELS = _HOSTS + """,
ovl as (select window_start_us, host, arg_max(cls, label_seq) cls from hosts join hl on ip = host
  and least(window_start_us + 3000000, t_end_us) - greatest(window_start_us, t_start_us) >= 800000 group by all),
lh as (select h.*, coalesce(cls, 'benign') label from hosts h left join ovl using (window_start_us, host))"""
_HOST_LABELS = _HOST_LABELS.replace(",\nbnd as", ",\nhl as (" + ctes("v_host_labels").split("as materialized (", 1)[1][:-1] + "),\nbnd as", 1)


def labelled_hosts(spark, sf_dir, rows=None):
    return ev.label_host_windows(host_rows(spark, sf_dir) if rows is None else rows, view(spark, sf_dir, "v_host_labels"))


@query("host_interval_label_join", _HOST_LABELS + "select window_start_us, host, label from lh")
def host_interval_label_join(spark, sf_dir):
    return labelled_hosts(spark, sf_dir).select("window_start_us", "host", "label")


@query("host_training_rows", _HOST_LABELS + f"select window_start_us, host, label from lh where {_CANDIDATE}")
def host_training_rows(spark, sf_dir):
    return candidate_hosts(labelled_hosts(spark, sf_dir), 20, 2).select("window_start_us", "host", "label")


# ---- metrics on stub scores ---------------------------------------------------------------------

_STUB = SCORES + """,
z as (select *, case when id % 3 = 0 then 'benign' else threat_class end y, case when prob >= 0.3 then threat_class else 'benign' end p from v_scores)"""


def _stub(spark, sf_dir):
    return scores(spark, sf_dir).withColumns({"y": F.when(F.col("id") % 3 == 0, "benign").otherwise(F.col("threat_class")),
                                              "p": F.when(F.col("prob") >= 0.3, F.col("threat_class")).otherwise("benign")})


def _metrics_sql(predicted, extra=""):
    return f"""select cls, round(case when cl > 0 then hit / cl else 0 end, 4) "precision", round(case when su > 0 then hit / su else 0 end, 4) recall,
 round(case when su + cl > 0 then 2 * hit / (su + cl) else 0 end, 4) f1, su support{extra} from (select cls, count(*) filter (y = cls and {predicted} = cls) hit,
 count(*) filter (y = cls) su, count(*) filter ({predicted} = cls) cl from z, (select distinct threat_class cls from v_scores) group by cls)"""


@query("confusion_metrics", _STUB + _metrics_sql("p"))
def confusion_metrics(spark, sf_dir):
    return ev.per_class(_stub(spark, sf_dir), "y", "p")


@query("benign_false_positives", _STUB + """
select round(count(*) filter (y = 'benign' and p <> 'benign') / count(*) filter (y = 'benign'), 5) benign_false_positive_rate, count(*) filter (y = 'benign') benign_support from z""")
def benign_false_positives(spark, sf_dir):
    return ev.benign_false_positives(_stub(spark, sf_dir), "y", "p")


_VARIANTS = SCORES + """,
z as (select *, case when id % 3 = 0 then 'benign' else threat_class end y, case when confidence_score >= 0.85 then threat_class else 'benign' end rl,
  case when prob >= 0.3 then threat_class else 'benign' end ml from v_scores),
"""
_VARIANTS = _VARIANTS.rstrip(",\n") + ", zz as (select *, case when rl <> 'benign' then rl else ml end hy from z)"


@query("variant_comparison", (_VARIANTS + " select * from (" + " union all ".join(
    _metrics_sql(c, f", '{v}' variant").replace("from z,", "from zz,") for c, v in (("rl", "rules"), ("ml", "model"), ("hy", "hybrid"))) + ")"))
def variant_comparison(spark, sf_dir):
    rows = _stub(spark, sf_dir).withColumns({
        "rule_label": F.when(F.col("confidence_score") >= 0.85, F.col("threat_class")).otherwise("benign"),
        "model_label": ev.model_label(0.3, "threat_class", "prob")})
    return ev.comparison(rows, "y")


@query("variant_table", _VARIANTS + """,
c as (select distinct threat_class cls from v_scores),
t as (select cls, count(*) filter (y = cls) su, count(*) filter (y = cls and rl = cls) r, count(*) filter (y = cls and ml = cls) m, count(*) filter (y = cls and hy = cls) h,
  count(*) filter (hy = cls) hc from zz, c group by cls)
select cls, round(r / su, 4) rules_recall, round(m / su, 4) model_recall, round(h / su, 4) hybrid_recall, round(h / hc, 4) hybrid_precision, su support from t""")
def variant_table(spark, sf_dir):
    return ev.comparison_table(variant_comparison(spark, sf_dir))


@query("flow_rule_labels", flow_ctes(30_000_000) + f""",
sc as (select flow_id, flow_start_us, {BEACON_SQL} b, {EXFIL_SQL} e from ff)
select flow_id, flow_start_us, case when b >= 0.7 and b >= e then 'Botnet_C2_Beaconing' when e >= 0.7 then 'Data_Exfiltration' else 'benign' end rule_label from sc""")
def flow_rule_labels(spark, sf_dir):
    rows = fill_defaults(flow_features(flows(packets(spark, sf_dir), SHORT_ACTIVE, splt=False)))
    return rows.select("flow_id", "flow_start_us", ev.rule_label([beaconing(), exfiltration()]).alias("rule_label"))


@query("score_quantile", SCORES + "select count(*) n, round(quantile_cont(prob * confidence_score, 0.9995), 9) quantile from v_scores")
def score_quantile(spark, sf_dir):
    rows = scores(spark, sf_dir).withColumn("s", F.col("prob") * F.col("confidence_score"))
    return ev.exact_quantile(rows, "s", 0.9995).withColumn("quantile", F.round("quantile", 9))


@query("threshold_calibration", SCORES + """
select 'flow' kind, count(*) n, round(least(0.995, greatest(0.85, quantile_cont(prob, 0.9) + 1e-6)), 4) threshold from v_scores""")
def threshold_calibration(spark, sf_dir):
    return ev.threshold(scores(spark, sf_dir), "flow", "prob", budget=0.1)


# ---- hybrid merge with a stub probability -------------------------------------------------------

_HYBRID = SCORES + """,
o as (select *, confidence_score >= 0.85 fired, id % 4 <> 0 speaks from v_scores),
m as (select id, threat_class, fired, case when not fired and speaks and prob >= 0.6 then true else false end only_model,
  speaks and prob >= 0.6 agrees, confidence_score c, prob p from o)"""


def _hybrid(spark, sf_dir):
    fired = F.col("confidence_score") >= 0.85
    # The stub prefers the rule's class except on every fourth row, where it says benign
    speaks = F.col("id") % 4 != 0
    cls = F.when(speaks, F.col("threat_class")).otherwise(F.lit("benign"))
    parts = opinion(F.col("confidence_score"), F.col("threat_class"), fired, cls, F.col("prob"),
                    F.when(speaks, F.col("prob")).otherwise(F.lit(0.0)), 0.6)
    return scores(spark, sf_dir).withColumns({**parts, "fired": fired})


@query("hybrid_merge", _HYBRID + """
select id, threat_class, round(case when only_model then least(0.89, p) when agrees then least(0.99, greatest(c, p)) else c end, 4) confidence_score,
 case when only_model then 'AI model' when agrees then 'Rules + AI model' else 'Rules' end detected_by from m where fired or only_model""")
def hybrid_merge(spark, sf_dir):
    return _hybrid(spark, sf_dir).filter("alerts").select("id", "threat_class", "confidence_score", "detected_by")


@query("model_only_anti", _HYBRID + "select id, threat_class, round(least(0.89, p), 4) confidence_score from m where only_model")
def model_only_anti(spark, sf_dir):
    return _hybrid(spark, sf_dir).filter("alerts and not fired").select("id", "threat_class", "confidence_score")


@query("alerts_by_detection_source", SCORES + """,
d as (select *, case when prob >= 0.6 then 'Rules + AI model' else 'Rules' end detected_by from v_scores)
select threat_class, detected_by, count(*) n, count(*) filter (src_ip = '10.0.1.3' or dst_ip = '10.0.1.3') involving, round(10000.0 * count(*) / 5000, 2) per_10k_flows from d group by all""")
def alerts_by_detection_source(spark, sf_dir):
    tagged = scores(spark, sf_dir).withColumn("evidence", F.when(F.col("prob") >= 0.6, F.lit('{"detected_by":"Rules + AI model"}')).otherwise(F.lit("{}")))
    return analytics.by_detection_source(tagged, 5000, "10.0.1.3")


# ---- from model to report, with a scorecard that SQL can state ----------------------------------

_FLOW_CARD = {1: ("packet_count % 3 = 0", 0.9, 0.05), 4: ("packet_count % 3 = 1 and total_bytes > 2000", 0.88, 0.02)}
_HOST_CARD = {1: ("in_packets % 4 = 0", 0.9, 0.04), 2: ("in_packets % 4 <> 0 and out_max_ports_on_one_host >= 3", 0.86, 0.03)}


def _scorecard(rules, classes):
    """A Spark ML model that gives each class of ``rules`` a probability by a condition, and the benign class the rest."""
    shares = {i: f"case when {rules[i][0]} then {rules[i][1]}D else {rules[i][2]}D end" if i in rules else "0.0D" for i in range(1, len(classes))}
    columns = [f"1.0D - ({' + '.join(shares.values())}) as _p0", *(f"{sql} as _p{i}" for i, sql in shares.items())]
    return PipelineModel([SQLTransformer(statement=f"select *, {', '.join(columns)} from __THIS__"),
                          VectorAssembler(inputCols=[f"_p{i}" for i in range(len(classes))], outputCol="probability")])


def scorecards():
    return forest.ThreatModel(_scorecard(_FLOW_CARD, forest.CLASSES["flow"]), _scorecard(_HOST_CARD, forest.CLASSES["host"]))


def _label_sql(card, names):
    return "case " + " ".join(f"when {card[i][0]} then '{names[i]}'" for i in card) + " else 'benign' end"


def _conf(sql):
    return sql.split("select *, ", 1)[1].rsplit(" conf from", 1)[0]


_REPORT = (_HOST_LABELS + ",\nv_flow_labels as materialized" + ctes("v_flow_labels").split("v_flow_labels as materialized", 1)[1]
           + _FLOW_LABELS[_FLOW_LABELS.index(",\npk as"):] + f""",
cand as (select *, in_packets packets, in_peak_pps peak_pps, in_syn_only_ratio syn_only_ratio, in_udp_ratio udp_ratio, in_unique_sources unique_sources,
 out_probe_ratio probe_ratio, out_max_ports_on_one_host max_ports_on_one_host, out_max_hosts_on_one_port max_hosts_on_one_port from lh where {_CANDIDATE}),
said as (
 select 'flow' kind, label, case when b >= 0.7 and b >= e then 'Botnet_C2_Beaconing' when e >= 0.7 then 'Data_Exfiltration' else 'benign' end rl, ml
  from (select label, {BEACON_SQL} b, {EXFIL_SQL} e, {_label_sql(_FLOW_CARD, forest.CLASSES["flow"])} ml from lf)
 union all select 'host', label, case when f >= 0.7::double then 'Volumetric_Protocol_DDoS' when s >= 0.7::double then 'Reconnaissance_Port_Scanning' else 'benign' end, ml
  from (select label, {_conf(_FLOOD_SQL)} f, {_conf(_SCAN_SQL)} s, {_label_sql(_HOST_CARD, forest.CLASSES["host"])} ml from cand)),
v as (select kind, label, 'rules' variant, rl said from said union all select kind, label, 'model', ml from said
 union all select kind, label, 'hybrid', case when rl <> 'benign' then rl else ml end from said),
known as (select * from (values """ + ", ".join(f"('{k}', '{c}')" for k in ("flow", "host") for c in forest.CLASSES[k]) + """) t(kind, cls), (values ('rules'), ('model'), ('hybrid')) u(variant)),
tot as (select variant, kind, cls, count(*) filter (label = cls and said = cls) hit, count(*) filter (label = cls) support, count(*) filter (said = cls) claimed
 from known left join v using (variant, kind) group by all)
""")


@query("holdout_report", _REPORT + """select variant, kind, cls, case when cls <> 'benign' then round(case when claimed > 0 then hit / claimed else 0 end, 4) end "precision",
 case when cls <> 'benign' then round(case when support > 0 then hit / support else 0 end, 4) end recall,
 case when cls <> 'benign' then round(case when support + claimed > 0 then 2 * hit / (support + claimed) else 0 end, 4) end f1, support,
 case when cls = 'benign' then round((support - hit) / greatest(1, support), 5) end false_positive_rate from tot""")
def holdout_report(spark, sf_dir):
    cfg = DetectionConfig(flow=SHORT_ACTIVE, flood=LOW_FLOOD, scan=LOW_SCAN)
    flow_rows = training.flow_training_rows(packets(spark, sf_dir), view(spark, sf_dir, "v_flow_labels"), cfg)
    hosts = training.host_training_rows(packets(spark, sf_dir), view(spark, sf_dir, "v_host_labels"), cfg, 20, 2)
    return training.holdout_report(scorecards(), flow_rows, hosts, cfg)


_CARD_SQL = BOTH + _HOSTS[len(BOTH):] + _FLOOD_SQL + _SCAN_SQL + flow_ctes(30_000_000)[flow_ctes(30_000_000).index(",\npk as"):] + f""",
op as (select window_start_us, host, {_label_sql(_HOST_CARD, forest.CLASSES["host"])} ml from hosts
 where in_packets >= 50 or out_max_ports_on_one_host >= 5 or out_max_hosts_on_one_port >= 5),
det as (
 select 'Volumetric_Protocol_DDoS' cls, conf >= 0.7::double fired, ml, last_ts_us ts_us, format('{{}}:*->{{}}:{{}}_{{}}', first_source, dst_ip, top_dst_port, protocol) flow_id,
   concat('*->', dst_ip) key, flood.window_start_us seq, first_source src, dst_ip dst from flood left join op on op.window_start_us = flood.window_start_us and host = dst_ip
 union all select 'Reconnaissance_Port_Scanning', conf >= 0.7::double, ml, last_ts_us, format('{{}}:*->{{}}:{{}}_{{}}', src_ip, tgt,
     case when max_ports_on_one_host >= max_hosts_on_one_port or horizontal_port = 0 then '*' else horizontal_port::varchar end, protocol),
   concat(src_ip, '->', tgt), window_start_us, src_ip, tgt
   from (select scan.*, ml, case when max_ports_on_one_host >= max_hosts_on_one_port then vertical_target else '*' end tgt
         from scan left join op on op.window_start_us = scan.window_start_us and host = src_ip)
 union all select c, conf >= 0.7, ml, last_us, flow_id, concat(src_ip, '->', dst_ip), flow_start_us, src_ip, dst_ip
   from (select *, unnest(['Botnet_C2_Beaconing', 'Data_Exfiltration']) c, unnest([{BEACON_SQL}, {EXFIL_SQL}]) conf, {_label_sql(_FLOW_CARD, forest.CLASSES["flow"])} ml from ff)),
alv as (select 'rules' variant, *, 'Rules' detected_by from det where fired
 union all select 'hybrid', *, case when not fired then 'AI model' when ml = cls then 'Rules + AI model' else 'Rules' end from det where fired or coalesce(ml = cls, false)),
al as (select *, concat(variant, key, '_', cls) dedup_key from alv)"""


@query("capture_evaluation", _CARD_SQL + chain_sql("dedup_key", "al") + """,
ranked as (select al.*, row_number() over (partition by dedup_key, ts_us order by flow_id, seq) rn from al),
pub as (select * from ranked join kept on k = dedup_key and t = ts_us where rn = 1)
select variant, cls threat_class, detected_by, count(*) n, count(*) filter (src = '10.0.1.3' or dst = '10.0.1.3') involving,
 round(10000.0 * count(*) / (select count(*) from ff), 2) per_10k_flows, (select count(*) from v_packets) packets, (select count(*) from ff) flows,
 sum(count(*)) over (partition by variant)::bigint alerts from pub group by variant, cls, detected_by""")
def capture_evaluation(spark, sf_dir):
    return training.capture_evaluation(packets(spark, sf_dir), scorecards(), DetectionConfig(flow=SHORT_ACTIVE), "10.0.1.3", four_rules())


@query("ml_scorecard_scores", flow_ctes(30_000_000) + f"""
select flow_id, flow_start_us, {_label_sql(_FLOW_CARD, forest.CLASSES["flow"])} ml_class,
 case when packet_count % 3 = 0 then 0.9 when packet_count % 3 = 1 and total_bytes > 2000 then 0.88 when packet_count % 3 = 1 then 0.93 else 0.93 end::double ml_prob from ff""")
def ml_scorecard_scores(spark, sf_dir):
    rows = with_flow_vector(flow_features(flows(packets(spark, sf_dir), SHORT_ACTIVE, splt=False)))
    return forest.predict(rows, scorecards().flow, forest.CLASSES["flow"]).select("flow_id", "flow_start_us", "ml_class", F.round("ml_prob", 6).alias("ml_prob"))


# ---- forests (not expressible in SQL) -----------------------------------------------------------

#: A flow or a host window kept back from the fit, in either SQL.
_HELD_FLOW = "substr(md5(concat_ws('|', flow_id, flow_start_us)), 1, 1) in ('0', '1', '2')"


def _flow_rows(spark, sf_dir, held):
    chosen = training.held_out("flow_id", "flow_start_us")
    return with_flow_vector(labelled_flows(spark, sf_dir)).filter(chosen if held else ~chosen)


def _host_training(spark, sf_dir, rows):
    hosts = with_host_vector(candidate_hosts(labelled_hosts(spark, sf_dir, rows), 20, 2))
    return hosts.filter(~training.held_out("window_start_us", "host")).select("features", "label")


#: Shape of the forests of queries that are about explanations, importances and alerts, where the full one only costs time.
_SMALL = {"trees": 10, "depth": 6}


def _fit_flows(spark, sf_dir, **shape):
    rows = _flow_rows(spark, sf_dir, held=False).select("features", "label")
    # Weights need counts of all rows, so the flows are computed once and written. They keep the order in which a shuffle
    # by class leaves the rows of a partition, since the samples of a forest depend on it.
    order = F.pmod(F.hash("label"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return forest.train("flow", materialize(rows.sortWithinPartitions(order)), **shape)


def _held_flow_scores(spark, sf_dir):
    rows = with_flow_vector(flow_features(flows(packets(spark, sf_dir), SHORT_ACTIVE, splt=False)))
    return forest.predict(rows.filter(training.held_out("flow_id", "flow_start_us")), _fit_flows(spark, sf_dir), forest.CLASSES["flow"])


@query("ml_flow_scores")
def ml_flow_scores(spark, sf_dir):
    return _held_flow_scores(spark, sf_dir).select("flow_id", "flow_start_us", "ml_class", F.round("ml_prob", 6).alias("ml_prob"))


@query("ml_score_facts", flow_ctes(30_000_000) + f"""
select flow_id, flow_start_us, 1.0::double prob_sum, true best_is_largest, true class_is_known from ff where {_HELD_FLOW}""")
def ml_score_facts(spark, sf_dir):
    """What holds of the scores of any forest: they add up to one, and the class told is the likeliest."""
    values = F.map_values("ml_probs")
    return _held_flow_scores(spark, sf_dir).select(
        "flow_id", "flow_start_us", F.round(F.aggregate(values, F.lit(0.0), lambda a, b: a + b), 6).alias("prob_sum"),
        ((F.col("ml_prob") == F.array_max(values)) & (F.col("ml_probs")[F.col("ml_class")] == F.col("ml_prob"))).alias("best_is_largest"),
        F.col("ml_class").isin(*forest.CLASSES["flow"]).alias("class_is_known"))


@query("ml_training_facts", _FLOW_LABELS + f""",
parts as (select label, {_HELD_FLOW} held from lf)
select label, count(*) filter (not held) n_fit, count(*) filter (held) n_held, round((select count(*) from parts where not held) / (select count(distinct label) from parts where not held), 4) weight,
 120 trees, true depth_within_16, true all_features from parts group by label having count(*) filter (not held) > 0""")
def ml_training_facts(spark, sf_dir):
    """The rows and weights a forest of full shape is fitted on, by class, and its shape."""
    model = _fit_flows(spark, sf_dir)
    held = training.held_out("flow_id", "flow_start_us")
    rows = labelled_flows(spark, sf_dir).withColumn("held", held)
    counts = rows.groupBy("label").agg(F.count_if(~F.col("held")).alias("n_fit"), F.count_if("held").alias("n_held"))
    weights = forest.with_balanced_weights(rows.filter(~F.col("held"))).groupBy("label").agg(F.round(F.sum("weight"), 4).alias("weight"))
    return counts.join(weights, "label").select(
        "label", "n_fit", "n_held", "weight", F.lit(model.getNumTrees).alias("trees"), F.lit(max(tree.depth for tree in model.trees) <= 16).alias("depth_within_16"),
        F.lit(model.numFeatures == len(forest.LAYOUT["flow"])).alias("all_features"))


@query("ml_host_scores")
def ml_host_scores(spark, sf_dir):
    hosts = materialize(host_rows(spark, sf_dir))
    model = forest.train("host", _host_training(spark, sf_dir, hosts))
    rows = with_host_vector(candidate_hosts(hosts, 20, 2)).filter(training.held_out("window_start_us", "host"))
    return forest.predict(rows, model, forest.CLASSES["host"]).select("window_start_us", "host", "ml_class", F.round("ml_prob", 6).alias("ml_prob"))


def _held_explanations(spark, sf_dir):
    rows = _flow_rows(spark, sf_dir, held=True).filter("label <> 'benign'")
    return forest.with_explanation(rows, _fit_flows(spark, sf_dir, **_SMALL), "flow", forest.CLASSES["flow"], target="label")


@query("ml_explain")
def ml_explain(spark, sf_dir):
    return (_held_explanations(spark, sf_dir).select("label", F.explode("factors").alias("f"))
            .groupBy("label", F.col("f.feature").alias("feature"))
            .agg(F.count("*").alias("n"), F.round(F.avg("f.contribution"), 4).alias("mean_contribution")))


@query("ml_explain_facts", _FLOW_LABELS + f"""
select label, count(*) n, count(*) n_sound from lf where label <> 'benign' and {_HELD_FLOW} group by label""")
def ml_explain_facts(spark, sf_dir):
    """Every attack has at most three factors, strongest first, none against its class, each named as in the vector."""
    told, named = F.col("factors.contribution"), F.array(*[F.lit(x) for x in forest.LAYOUT["flow"].values()])
    sound = ((F.size("factors") <= 3) & F.forall(told, lambda c: c >= 0) & (F.reverse(F.array_sort(told)) == told)
             & (F.size(F.array_except(F.col("factors.feature"), named)) == 0) & (F.size(F.array_distinct(F.col("factors.feature"))) == F.size("factors")))
    return _held_explanations(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.count_if(sound).alias("n_sound"))


@query("ml_feature_importance")
def ml_feature_importance(spark, sf_dir):
    flow_model = _fit_flows(spark, sf_dir, **_SMALL)
    return forest.feature_importance(forest.ThreatModel(flow_model, flow_model), "flow").limit(10)


@query("ml_importance_facts", _FLOW_LABELS + f"""
select count(*) n_fit, 35 features, 1.0::double total, true none_negative from lf where not {_HELD_FLOW}""")
def ml_importance_facts(spark, sf_dir):
    """Importances of all vector entries: none is negative, and together they are one."""
    flow_model = _fit_flows(spark, sf_dir, **_SMALL)
    told = forest.feature_importance(forest.ThreatModel(flow_model, flow_model), "flow").agg(
        F.countDistinct("feature").cast("int").alias("features"), F.round(F.sum("importance"), 6).alias("total"), (F.min("importance") >= 0).alias("none_negative"))
    return _flow_rows(spark, sf_dir, held=False).agg(F.count("*").alias("n_fit")).join(told)


@query("ml_hybrid_alerts")
def ml_hybrid_alerts(spark, sf_dir):
    """The whole detection with rules and forests: published alerts per class and source."""
    hosts = _host_training(spark, sf_dir, materialize(host_rows(spark, sf_dir)))
    model = forest.ThreatModel(_fit_flows(spark, sf_dir, **_SMALL), forest.train("host", hosts, **_SMALL), {"flow": 0.5, "host": 0.5})
    cfg = DetectionConfig(flood=LOW_FLOOD, scan=LOW_SCAN)
    alerts = detection.run(packets(spark, sf_dir), cfg, model)
    return alerts.groupBy("threat_class", F.get_json_object("evidence", "$.detected_by").alias("detected_by")).agg(F.count("*").alias("n"))
