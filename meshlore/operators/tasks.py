"""Prompted tasks over tables: filled prompts, cached generation, parsing; and the accounting of calls from logs.

A provider is a function from requests (key, system, user, assistant) to answers (key, raw, prompt_tokens, generated_tokens, elapsed); `stub` gives canned
answers inside the JVM, `batched` calls a plain Python function on Arrow batches. Equal requests are generated once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlore.functions.parsers import detect_language

ANSWERS = "key string, raw string, prompt_tokens long, generated_tokens long, elapsed double"
#: Fixed value: stands for a missing assistant prompt in cache keys.
NO_PROMPT = "__<|None|>__"


def stub(answers: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Canned answers in turn over the hash of the request, so that a retried task gives the same; none: empty answers."""
    pool = F.array(*[F.lit(a) for a in answers or [""]])
    pick = F.get(pool, F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(max(len(answers), 1))).cast("int"))
    return lambda requests: requests.select("key", pick.alias("raw"), F.lit(0).cast("long").alias("prompt_tokens"), F.lit(0).cast("long").alias("generated_tokens"), F.lit(0.0).alias("elapsed"))


def batched(generate: Callable[[str, str, str | None], tuple[str, int, int, float]]) -> Callable[[DataFrame], DataFrame]:
    """A provider of generate(system, user, assistant) -> (text, prompt tokens, generated tokens, seconds)."""

    def work(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            made = [(k, *generate(s, u, a)) for k, s, u, a in f[["key", "system", "user", "assistant"]].itertuples(index=False)]
            yield pd.DataFrame(made, columns=["key", "raw", "prompt_tokens", "generated_tokens", "elapsed"])

    return lambda requests: requests.select("key", "system", "user", "assistant").mapInPandas(work, ANSWERS)


def chat(url: str, model: str, style: str = "openai", options: dict | None = None, token: str | None = None, timeout: float = 60.0, trials: int = 5, wait: float = 10.0) -> Callable[[str, str, str | None], tuple[str, int, int, float]]:
    """A function for `batched` that asks a chat server, in the OpenAI or the Ollama form; lost connections are tried again."""
    if style not in ("openai", "ollama"):
        raise ValueError("style must be openai or ollama")
    path = "/chat/completions" if style == "openai" else "/api/chat"

    def generate(system: str, user: str, assistant: str | None) -> tuple[str, int, int, float]:
        import json
        import time
        from urllib.error import URLError
        from urllib.request import Request, urlopen

        from meshlore.sources.parquet import retried

        told = [("system", system), ("user", user), *([("assistant", assistant)] if assistant is not None else [])]
        body = {"model": model, "messages": [{"role": r, "content": c} for r, c in told], "stream": False, **({"options": options or {}} if style == "ollama" else options or {})}
        head = {"Content-Type": "application/json", **({"Authorization": f"Bearer {token}"} if token else {})}

        @retried(trials, wait, (URLError, ConnectionError, TimeoutError))
        def post() -> dict:
            with urlopen(Request(url.rstrip("/") + path, json.dumps(body).encode(), head), timeout=timeout) as answer:
                return json.load(answer)

        start = time.time()
        got = post()
        if style == "ollama":
            return got["message"]["content"], got.get("prompt_eval_count", 0), got.get("eval_count", 0), time.time() - start
        used = got.get("usage", {})
        return got["choices"][0]["message"]["content"], used.get("prompt_tokens", 0), used.get("completion_tokens", 0), time.time() - start

    return generate


def fill(template: Column, values: dict[str, Column]) -> Column:
    """The template with {name} replaced; null if a placeholder stays without value. Values are not scanned for placeholders."""
    parts = F.split(template, r"(?=\{\w+\})|(?<=\})")
    put = lambda p: F.coalesce(*[F.when(p == F.lit(f"{{{k}}}"), v) for k, v in values.items()], F.when(~p.rlike(r"^\{\w+\}$"), p)) if values else F.when(~p.rlike(r"^\{\w+\}$"), p)
    filled = F.transform(parts, put)
    return F.when(~F.exists(filled, lambda p: p.isNull()), F.array_join(filled, ""))


def solve(rows: DataFrame, values: dict[str, Column], prompts: DataFrame, provider, parse: Callable[[Column], Column], save, lang: str = "auto", cache: DataFrame | None = None, strategy: str = "") -> tuple[DataFrame, DataFrame]:
    """(results, new cache rows): rows with result, status, cache_hit, key.

    prompts: (lang, system, user, assistant), one row a language, a handful. cache: (key, raw). Status, by the first step that fails: empty_input_text,
    not_supported_lang, bad_user_prompt, bad_parser (parse gives null), else success. Only successes that were generated enter the cache.
    """
    text = F.concat_ws(", ", *values.values())
    known = detect_language(text) if lang == "auto" else F.lit(lang)
    named = rows.withColumns({"_empty": F.length(text) == 0, "_lang": known}).withColumns({f"_v_{k}": v for k, v in values.items()})
    suite = prompts.select(F.col("lang").alias("_lang"), F.col("system").alias("_system"), F.col("user").alias("_user"), F.col("assistant").alias("_assistant"))
    asked = named.join(suite, "_lang", "left").withColumn("_user", fill(F.col("_user"), {k: F.col(f"_v_{k}") for k in values})).drop(*[f"_v_{k}" for k in values])
    before = F.when(F.col("_empty") & F.lit(lang == "auto"), "empty_input_text").when(F.col("_system").isNull(), "not_supported_lang").when(F.col("_user").isNull(), "bad_user_prompt")
    parts = [F.col("_system"), F.col("_user"), F.coalesce("_assistant", F.lit(NO_PROMPT))]
    key = F.sha1(F.concat(*[F.sha1(p) for p in parts], F.sha1(F.lit(strategy))))
    asked = save(asked.withColumn("status", before).withColumn("key", F.when(F.col("status").isNull(), key)), "asked")
    wanted = asked.filter("key is not null").groupBy("key").agg(*[F.min(f"_{c}").alias(c) for c in ("system", "user", "assistant")])
    old = None if cache is None else cache.select("key", "raw").dropDuplicates(["key"])
    fresh = save(provider(wanted if old is None else wanted.join(old, "key", "left_anti")), "fresh")
    have = fresh.select("key", "raw", F.lit(False).alias("cache_hit"))
    if old is not None:
        have = have.union(old.join(wanted.select("key"), "key", "left_semi").select("key", "raw", F.lit(True)))
    out = asked.join(have, "key", "left").withColumn("result", parse(F.col("raw")))
    out = out.withColumn("status", F.coalesce("status", F.when(F.col("result").isNull(), "bad_parser"), F.lit("success"))).withColumn("cache_hit", F.coalesce("cache_hit", F.lit(False)))
    results = out.select(*rows.columns, "result", "status", "cache_hit", "key")
    return results, fresh.filter(parse(F.col("raw")).isNotNull()).select("key", "raw")


def call_counts(log: DataFrame, starts: Column, step: Column, clues: Column, most_steps: int) -> DataFrame:
    """Calls of each task in every question of a log, rebuilt from its markers.

    log: (log, line_no, ...); starts and step are true on the lines that begin a question and a search step, clues is the number of clue queries made
    at a line (null: none). Lines before a log's first question count nowhere. A question of s steps has s extractions, summaries and classifications, s - 1 plan
    checks, one first plan, and a strict answer if s is most_steps, else a free one. Logs are told apart, so that no window spans them all.
    """
    w = Window.partitionBy("log").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("question", F.sum(F.when(starts, 1).otherwise(0)).over(w)).filter("question > 0")
    s = rows.groupBy("log", "question").agg(F.sum(F.when(step, 1).otherwise(0)).alias("s"), F.coalesce(F.sum(clues), F.lit(0)).cast("long").alias("c"))
    strict = F.when(F.col("s") == most_steps, 1).otherwise(0).cast("long")
    per_step = [F.col("s").alias(n) for n in ("entities_extractor", "clueanswers_summarizer", "answer_classify")]
    return s.select("log", "question", *per_step, (F.col("s") - 1).alias("searchplan_enhance_classify"), (F.col("s") - 1).alias("plan_enhancing"), F.col("c").alias("cluequeries_generator"), F.col("c").alias("clueanswer_generator"), F.lit(1).cast("long").alias("plan_initialing"), strict.alias("strict_answer_gen"), (1 - strict).alias("casual_answer_gen"))


def token_sums(calls: DataFrame, means: DataFrame) -> DataFrame:
    """(task, calls, prompt_tokens, generated_tokens): calls of each task (its columns of `call_counts`) times means (task, prompt_tokens, generated_tokens)."""
    names = [c for c in calls.columns if c not in ("log", "question")]
    total = calls.agg(*[F.sum(c).alias(c) for c in names])
    each = total.select(F.explode(F.array(*[F.struct(F.lit(c).alias("task"), F.col(c).alias("calls")) for c in names])).alias("x")).select("x.*")
    return each.join(means, "task").select("task", "calls", *[F.round(F.col("calls") * F.col(c), 3).alias(c) for c in ("prompt_tokens", "generated_tokens")])
