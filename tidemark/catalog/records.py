"""Instruction records, prompts, conformance and text evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.catalog.base import BARS, FEATURE_SQL, PREDICTIONS, query, r, rounded
from tidemark.catalog.features import features
from tidemark.operators import records as rec
from tidemark.operators import texteval as te
from tidemark.operators.targets import label_name
from tidemark.sources.sinks import read_messages, write_jsonl
from tidemark.sources.storage import fresh_path, stored

# Attributions that need no model: how far an indicator is from its neutral value.
NEUTRAL = {"price_vs_sma20": 0.0, "rsi_14": 50.0, "bb_pct_b": 0.5, "volume_ratio": 1.0, "return_5d": 0.0}
SCALE = {"rsi_14": 50.0}
SHOWN = ["rsi_14", "sma_20", "ema_20", "macd", "atr_14", "bb_pct_b", "volume_ratio", "return_1d", "return_5d"]
LIMIT = 2000


def attributions():
    shap = {f: (F.col(f) - v) / SCALE.get(f, 1.0) for f, v in NEUTRAL.items()}
    return rec.attribution_list(list(NEUTRAL), shap)


_TOP = (
    "list_sort(["
    + ", ".join(
        f"{{'key': -abs(({f} - {v!r}E0) / {SCALE.get(f, 1.0)!r}E0), 'pos': {i}, 'feature': '{f}', "
        f"'shap_value': ({f} - {v!r}E0) / {SCALE.get(f, 1.0)!r}E0, 'raw_value': {f}}}"
        for i, (f, v) in enumerate(NEUTRAL.items())
    )
    + "])"
)


@query(
    "topk_features",
    f"WITH {FEATURE_SQL}, x AS (SELECT split, Symbol, Date, {_TOP} AS a FROM feat) "
    "SELECT split, Symbol, Date, "
    + ", ".join(
        f"a[{i}].feature AS feature_{i}, {r(f'a[{i}].shap_value')} AS shap_{i}, {r(f'a[{i}].raw_value')} AS raw_{i}" for i in (1, 2, 3)
    )
    + " FROM x",
)
def topk_features(spark, sf):
    top = features(spark, sf).select("split", "Symbol", "Date", rec.top_features(attributions(), 3).alias("t"))
    cells = [
        F.col("t")[i - 1][f].alias(f"{n}_{i}")
        for i in (1, 2, 3)
        for n, f in (("feature", "feature"), ("shap", "shap_value"), ("raw", "raw_value"))
    ]
    return rounded(top.select("split", "Symbol", "Date", *cells))


def model_outputs(spark, sf):
    """Label, class probabilities and top features of one model per bar."""
    own = F.floor(F.col("confidence") * 100 + 0.5) / 100
    rest = (1 - own) / 2
    p = lambda k: F.when(F.col("prediction") == k, own).otherwise(rest)
    return fx.predictions(spark, sf).where("model = 'reversal1'").select(
        "Symbol",
        "Date",
        label_name(F.col("prediction")).alias("prediction_label"),
        F.create_map(F.lit("BUY"), p(2), F.lit("HOLD"), p(1), F.lit("SELL"), p(0)).alias("probabilities"),
    )


def records(spark, sf, limit=None):
    # Stored first: numbering the rows reads them twice.  Only what a record shows is stored and numbered.
    used = dict.fromkeys([*SHOWN, *NEUTRAL])
    rows = stored(features(spark, sf).select("split", "Symbol", "Date", *used), "features")
    return rec.instruction_records(rows, model_outputs(spark, sf), SHOWN, limit, top=rec.top_features(attributions(), 5))


# The prediction rules, to follow a chain that already has the bars.
_RULES = PREDICTIONS[len(BARS):]


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_OWN = "floor(confidence * 100 + 0.5E0) / 100"
_P = f"CASE WHEN prediction = {{k}} THEN {_OWN} ELSE (1 - {_OWN}) / 2 END"
_RECORDS = (
    FEATURE_SQL
    + _RULES
    + f""",
pos AS (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY Symbol, Date) - 1 AS row_id, {_TOP} AS a FROM feat),
joined AS (
  SELECT pos.*, coalesce(CASE prediction WHEN 0 THEN 'SELL' WHEN 1 THEN 'HOLD' WHEN 2 THEN 'BUY' END, 'BUY') AS label,
         coalesce({_P.format(k=2)}, 0.7E0) AS pb, coalesce({_P.format(k=1)}, 0.2E0) AS ph, coalesce({_P.format(k=0)}, 0.1E0) AS ps
  FROM pos LEFT JOIN (SELECT * FROM predictions WHERE model = 'reversal1') p ON pos.Symbol = p.Symbol AND pos.Date = p.Date),
named AS (
  SELECT *, [{', '.join(_quote(t) for t in rec.TASKS)}][CAST(row_id % 6 + 1 AS INTEGER)] AS task_type,
         CASE WHEN greatest(pb, ph, ps) > 0.6 THEN 'HIGH' ELSE 'MEDIUM' END AS tier FROM joined),
prompts AS (
  SELECT *, concat_ws(chr(10), 'TASK: ' || task_type, 'MODEL_PREDICTION: ' || label, 'CONFIDENCE_LEVEL: ' || tier,
    'PROBABILITIES: {{''BUY'': ' || CAST(pb AS VARCHAR) || ', ''HOLD'': ' || CAST(ph AS VARCHAR) || ', ''SELL'': ' || CAST(ps AS VARCHAR) || '}}',
    'TOP_SHAP_FEATURES:', """
    + ", ".join(
        f"'  - ' || a[{i}].feature || printf(': value=%.4f, contribution=%+.4f', a[{i}].raw_value, a[{i}].shap_value)" for i in range(1, 6)
    )
    + ", 'KEY_TECHNICAL_INDICATORS:', "
    + ", ".join(f"'  - {c}: ' || printf('%.4f', {c})" for c in SHOWN[:8])
    + """) AS user_text,
    concat_ws(chr(10), '{', '  "signal": "' || label || '",', '  "confidence": "' || tier || '",', '  "why": "Model generated ' || label
      || ' signal primarily driven by top technical indicators: ' || a[1].feature || ', ' || a[2].feature || '.",',
      '  "key_drivers": [', '    "' || a[1].feature || '",', '    "' || a[2].feature || '",', '    "' || a[3].feature || '"', '  ],',
      '  "conflicts_risks": [],', '  "model_interpretation": "High confidence attribution based on ' || task_type || ' analysis."', '}') AS answer
  FROM named)"""
)


@query(
    "instruction_records",
    f"WITH {_RECORDS} SELECT split, row_id, Symbol, Date, task_type, {_quote(rec.SYSTEM_PROMPT)} AS system_text, "
    "user_text, answer FROM prompts",
)
def instruction_records(spark, sf):
    m = F.col("messages")
    return records(spark, sf).select(
        "split", "row_id", "Symbol", "Date", "task_type",
        m[0]["content"].alias("system_text"), m[1]["content"].alias("user_text"), m[2]["content"].alias("answer"),
    )


@query("instruction_counts", f"WITH {FEATURE_SQL} SELECT split, count(*) AS n_records FROM feat GROUP BY split")
def instruction_counts(spark, sf):
    return rec.instruction_counts(records(spark, sf))


@query("instruction_head", f"WITH {FEATURE_SQL} SELECT split, least(count(*), {LIMIT}) AS n_records FROM feat GROUP BY split")
def instruction_head(spark, sf):
    """The head limit per split as a feature of its own."""
    return rec.instruction_counts(records(spark, sf, LIMIT))


@query(
    "prompt_text",
    f"WITH {FEATURE_SQL}, x AS (SELECT split, Symbol, Date, {_TOP} AS a, {', '.join(SHOWN)} FROM feat) "
    "SELECT split, Symbol, Date, concat_ws(chr(10), 'TASK: COMPLETE_ANALYST', 'MODEL_PREDICTION: HOLD', 'CONFIDENCE_LEVEL: HIGH', "
    "'PROBABILITIES: {''BUY'': 0.7, ''HOLD'': 0.2, ''SELL'': 0.1}', 'TOP_SHAP_FEATURES:', "
    + ", ".join(
        f"'  - ' || a[{i}].feature || printf(': value=%.4f, contribution=%+.4f', a[{i}].raw_value, a[{i}].shap_value)" for i in (1, 2)
    )
    + ", 'KEY_TECHNICAL_INDICATORS:', "
    + ", ".join(f"'  - {c}: ' || printf('%.4f', {c})" for c in SHOWN[:8])
    + ") AS prompt FROM x",
)
def prompt_text(spark, sf):
    text = rec.prompt_text(
        F.lit("COMPLETE_ANALYST"), F.lit("HOLD"), F.lit("HIGH"), rec.default_probabilities(),
        rec.top_features(attributions(), 2), SHOWN,
    )
    return features(spark, sf).select("split", "Symbol", "Date", text.alias("prompt"))


@query(
    "sink_jsonl",
    f"WITH {_RECORDS} SELECT split, count(*) AS n_records, CAST(sum(length(user_text)) AS BIGINT) AS user_chars, "
    "CAST(sum(length(answer)) AS BIGINT) AS answer_chars FROM prompts GROUP BY split",
)
def sink_jsonl(spark, sf):
    path = fresh_path(spark, "jsonl")
    write_jsonl(records(spark, sf), path)
    from tidemark.sources.sinks import MESSAGES

    back = spark.read.schema(f"messages {MESSAGES.simpleString()}, split string").json(path)
    return back.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.sum(F.length(F.col("messages")[1]["content"])).alias("user_chars"),
        F.sum(F.length(F.col("messages")[2]["content"])).alias("answer_chars"),
    )


_FAULT = "CAST(year(Date) * 10000 + month(Date) * 100 + day(Date) AS BIGINT)"


def explanation_json(spark, sf):
    """Nested explanation records as JSON, some with faults planted by date."""
    ymd = F.year("Date") * 10000 + F.month("Date") * 100 + F.dayofmonth("Date")
    out = model_outputs(spark, sf)
    rows = features(spark, sf).join(out, ["Symbol", "Date"])
    p = F.col("probabilities")
    record = F.struct(
        F.concat("Symbol", F.lit("_"), F.col("Date").cast("string")).alias("example_id"),
        F.when(ymd % 23 == 0, "SMALL_TALK").otherwise("SIGNAL_EXPLANATION").alias("task_type"),
        F.upper("split").alias("temporal_split"),
        F.struct(
            F.struct(F.col("Symbol").alias("ticker"), F.col("Date").cast("string").alias("date")).alias("metadata"),
            F.struct(
                F.col("prediction_label").alias("xgb_prediction"),
                p["SELL"].alias("p_sell"),
                p["HOLD"].alias("p_hold"),
                F.when(ymd % 31 == 0, F.lit(1.5)).otherwise(p["BUY"]).alias("p_buy"),
                F.array_max(F.map_values(p)).alias("confidence"),
            ).alias("quantitative_predictions"),
            F.create_map(*[x for c in SHOWN for x in (F.lit(c), F.col(c))]).alias("technical_indicators"),
            F.struct(F.array(F.lit("rsi_14")).alias("global_importance_rank")).alias("shap_explanations"),
        ).alias("input_context"),
        F.when(ymd % 37 != 0, F.lit("text")).alias("output_explanation"),
    )
    json = F.to_json(record)
    return rows.select("split", "Symbol", "Date", F.when(ymd % 41 == 0, F.lit("not json")).otherwise(json).alias("json"))


@query(
    "record_conformance",
    f"WITH {FEATURE_SQL}{_RULES}, x AS (SELECT feat.*, {_FAULT.replace('Date', 'feat.Date')} AS ymd FROM feat "
    "JOIN (SELECT Symbol, Date FROM predictions WHERE model = 'reversal1') p ON feat.Symbol = p.Symbol AND feat.Date = p.Date) "
    "SELECT split, Symbol, Date, CASE WHEN ymd % 41 = 0 THEN 'missing example_id; missing task_type; missing temporal_split; missing input_context; missing output_explanation; "
    "missing metadata; missing metadata.ticker; missing metadata.date; missing quantitative_predictions; missing technical_indicators; missing shap_explanations; "
    "missing quantitative_predictions.xgb_prediction; missing quantitative_predictions.p_sell; missing quantitative_predictions.p_hold; "
    "missing quantitative_predictions.p_buy; missing quantitative_predictions.confidence' "
    "ELSE concat_ws('; ', CASE WHEN ymd % 37 = 0 THEN 'missing output_explanation' END, CASE WHEN ymd % 23 = 0 THEN 'bad value task_type' END, "
    "CASE WHEN ymd % 31 = 0 THEN 'out of range quantitative_predictions.p_buy' END) END AS issues, "
    "ymd % 41 <> 0 AND ymd % 37 <> 0 AND ymd % 23 <> 0 AND ymd % 31 <> 0 AS conforms FROM x",
)
def record_conformance(spark, sf):
    return rec.check_records(explanation_json(spark, sf)).select(
        "split", "Symbol", "Date", F.concat_ws("; ", "issues").alias("issues"), "conforms"
    )


def texts(spark, sf):
    """Documents as explanation texts, each with an expected label and features."""
    return fx.table(spark, sf, "documents").select(
        "doc_id",
        F.col("source").alias("model"),
        F.element_at(F.array(F.lit("the"), F.lit("BUY"), F.lit("eau")), (F.col("doc_id") % 3 + 1).cast("int")).alias("label"),
        F.array(F.lit("the"), F.lit("RSI_14"), F.lit("ion"), F.col("lang")).alias("features"),
        "text",
    )


def _contains(terms, low: str = "low") -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN contains({low}, {_quote(t)}) THEN {_quote(t)} END" for t in terms) + ")"


_TEXTS = f"""
x AS (SELECT doc_id, source AS model, ['the', 'BUY', 'eau'][CAST(doc_id % 3 + 1 AS INTEGER)] AS label, lang, lower(text) AS low FROM documents),
y AS (SELECT *, contains(low, lower(label)) AS signal_consistent, {_contains(te.EXTERNAL_TERMS)} AS hallucinations,
             {_contains(te.CAUSAL_TERMS)} AS causal_claims,
             concat_ws(',', CASE WHEN contains(low, 'the') THEN 'the' END, CASE WHEN contains(low, 'rsi_14') THEN 'RSI_14' END,
               CASE WHEN contains(low, 'ion') THEN 'ion' END, CASE WHEN contains(low, lang) THEN lang END) AS features_grounded FROM x),
z AS (SELECT *, hallucinations <> '' AS hallucination_detected, causal_claims <> '' AS causal_claims_detected,
             (contains(low, 'the')::INT + contains(low, 'rsi_14')::INT + contains(low, 'ion')::INT + contains(low, lang)::INT) / 4.0E0 AS grounding_score FROM y)"""


@query(
    "text_eval",
    f"WITH {_TEXTS} SELECT doc_id, signal_consistent, hallucinations, hallucination_detected, causal_claims, "
    "causal_claims_detected, features_grounded, grounding_score FROM z",
)
def text_eval(spark, sf):
    out = te.evaluate_texts(texts(spark, sf))
    join = lambda c: F.concat_ws(",", c).alias(c)
    return out.select(
        "doc_id", "signal_consistent", join("hallucinations"), "hallucination_detected", join("causal_claims"),
        "causal_claims_detected", join("features_grounded"), "grounding_score",
    )


@query(
    "text_eval_rates",
    f"WITH {_TEXTS} SELECT model, count(*) AS n, {r('avg(signal_consistent::INT) * 100')} AS consistency_pct, "
    f"{r('avg(hallucination_detected::INT) * 100')} AS hallucination_pct, {r('avg(causal_claims_detected::INT) * 100')} AS causal_pct, "
    f"{r('avg(grounding_score)')} AS grounding FROM z GROUP BY model",
)
def text_eval_rates(spark, sf):
    return rounded(te.text_eval_rates(te.evaluate_texts(texts(spark, sf))))


@query(
    "chat_text_eval",
    "WITH x AS (SELECT role AS model, 'que' AS label, lower(text) AS low FROM conversations), "
    f"y AS (SELECT *, {_contains(te.EXTERNAL_TERMS)} AS h, {_contains(te.CAUSAL_TERMS)} AS c FROM x) "
    f"SELECT model, count(*) AS n, {r('avg(contains(low, label)::INT) * 100')} AS consistency_pct, "
    f"{r('avg((length(h) > 0)::INT) * 100')} AS hallucination_pct, {r('avg((length(c) > 0)::INT) * 100')} AS causal_pct, "
    f"{r('avg(contains(low, CHR(110))::INT)')} AS grounding FROM y GROUP BY model",
)
def chat_text_eval(spark, sf):
    chats = fx.table(spark, sf, "conversations").select(
        F.col("role").alias("model"), F.lit("que").alias("label"), F.array(F.lit("n")).alias("features"), "text"
    )
    return rounded(te.text_eval_rates(te.evaluate_texts(chats)))


@query(
    "chat_flatten",
    "SELECT conv_id, CAST(0 AS BIGINT) AS part, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text "
    "FROM conversations GROUP BY conv_id",
)
def chat_flatten(spark, sf):
    return te.flatten_chat(te.conversation_records(fx.table(spark, sf, "conversations")))


_MARKED = "'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)"


@query(
    "chat_turns",
    f"WITH x AS (SELECT conv_id, turn, {_MARKED} AS text FROM conversations) SELECT conv_id, turn, text, "
    "CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) AS BIGINT) AS at FROM x",
)
def chat_turns(spark, sf):
    return te.flatten_turns(fx.table(spark, sf, "conversations"))


@query(
    "read_messages",
    "SELECT role, count(*) AS n_messages, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY role",
)
def messages(spark, sf):
    path = fresh_path(spark, "chats")
    write_jsonl(te.conversation_records(fx.table(spark, sf, "conversations")), path, ())
    one = read_messages(spark, path).select(F.explode("messages").alias("m"))
    return one.groupBy("m.role").agg(
        F.count(F.lit(1)).alias("n_messages"), F.sum(F.length("m.content")).alias("n_chars")
    )
