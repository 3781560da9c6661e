"""The driver tables as the frames of an execution-log analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, step, role, name (with hand-off), content, n_bytes."""
    name = F.when(F.col("role") == "system", "system (-> user)").when(F.col("role") == "user", "user (-> assistant)").otherwise("assistant")
    return load(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("step"), "role", name.alias("name"), F.coalesce("text", F.lit("")).alias("content"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, source, n_steps, mistake_step, mistake_agent: labels, apart from the steps."""
    s = steps(spark, sf_dir)
    n = s.groupBy("conv_id").agg(F.count("*").alias("n_steps"))
    at = n.withColumn("mistake_step", F.pmod(F.col("conv_id") * 7 + 3, F.col("n_steps")))
    who = s.select("conv_id", F.col("step").alias("mistake_step"), F.col("name").alias("mistake_agent"))
    return at.join(who, ["conv_id", "mistake_step"]).select("conv_id", F.pmod("conv_id", F.lit(5)).alias("source"), "n_steps", "mistake_step", "mistake_agent")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, predicted_step, predicted_role: the longest step of each case; every tenth case has none."""
    s = steps(spark, sf_dir).where("conv_id % 10 <> 0")
    return s.groupBy("conv_id").agg(F.max_by(F.struct("step", "role"), F.struct("n_bytes", -F.col("step"))).alias("b")).select("conv_id", F.col("b.step").alias("predicted_step"), F.col("b.role").alias("predicted_role"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question, option, p, choice: a user's share of each event type, the last event as the choice."""
    e = load(spark, sf_dir, "events")
    c = e.groupBy(F.col("user_id").alias("question"), F.col("event_type").alias("option")).agg(F.count("*").cast("double").alias("n"))
    total = e.groupBy(F.col("user_id").alias("question")).agg(F.count("*").cast("double").alias("total"), F.max_by("event_type", F.struct("ts", "event_id")).alias("choice"))
    return c.join(total, "question").select("question", "option", (F.col("n") / F.col("total")).alias("p"), "choice")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question, kind, truth: a user's first event."""
    e = load(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("question")).agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("truth")).select("question", F.concat(F.lit("k"), F.pmod("question", F.lit(3)).cast("string")).alias("kind"), "truth")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, ts, event_id, tokens, cost, phase."""
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), "ts", "event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("tokens"), F.col("value").cast("double").alias("cost"), F.col("event_type").alias("phase"))


#: The same frames in DuckDB SQL, as common table expressions.
CTES = {
    "steps": "steps as (select conv_id, turn as step, role, case role when 'system' then 'system (-> user)' when 'user' then 'user (-> assistant)' else 'assistant' end as name, coalesce(text, '') as content, strlen(coalesce(text, ''))::bigint as n_bytes from conversations)",
    "gold": "gold as (select c.conv_id, c.conv_id % 5 as source, c.n_steps, s.step as mistake_step, s.name as mistake_agent from (select conv_id, count(*) as n_steps from steps group by 1) c join steps s on s.conv_id = c.conv_id and s.step = (c.conv_id * 7 + 3) % c.n_steps)",
    "pred": "pred as (select conv_id, step as predicted_step, role as predicted_role from steps where conv_id % 10 <> 0 qualify row_number() over (partition by conv_id order by n_bytes desc, step) = 1)",
    "scored": "scored as (select *, coalesce(regexp_replace(lower(predicted_role), '\\s*\\(\\s*->.*$', '') = regexp_replace(lower(mistake_agent), '\\s*\\(\\s*->.*$', ''), false) as role_correct, coalesce(predicted_step = mistake_step, false) as step_exact, coalesce(abs(predicted_step - mistake_step) <= 5, false) as step_near, abs(predicted_step - mistake_step) as step_error from gold left join pred using (conv_id))",
    "answers": "answers as (select user_id as question, event_type as option, count(*)::double / t.total as p, t.choice from events join (select user_id, count(*)::double as total, arg_max(event_type, (ts, event_id)) as choice from events group by 1) t using (user_id) group by user_id, event_type, t.total, t.choice)",
    "truth": "truth as (select user_id as question, 'k' || (user_id % 3)::varchar as kind, arg_min(event_type, (ts, event_id)) as truth from events group by 1, 2)",
    "calls": "calls as (select user_id as case_id, ts, event_id, coalesce(try_cast(props->>'$.k' as bigint), 0) as tokens, value::double as cost, event_type as phase from events)",
    "handoff": "handoff as (select a.conv_id, a.step, a.name, coalesce(max(case when b.to_role = regexp_replace(lower(a.name), '\\s*\\(\\s*->.*$', '') then b.step end), max(b.step)) as handoff_step, max(case when b.to_role = regexp_replace(lower(a.name), '\\s*\\(\\s*->.*$', '') then b.step end) is not null as addressed from steps a left join (select conv_id, step, lower(regexp_extract(name, '\\(\\s*->\\s*(.*?)\\)', 1)) as to_role from steps) b on b.conv_id = a.conv_id and b.step < a.step and b.to_role <> '' group by 1, 2, 3)",
}


def ctes(*names: str) -> str:
    return "with recursive " + ", ".join(CTES[n] for n in names) + " "
