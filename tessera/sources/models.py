"""A model server as a source: prompts in, checked JSON out. Without a server the rules in ``functions.text`` are used."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import fill_prompt, model_installed

ATTEMPTS, SECONDS = 3, 120
REPAIR = "\nAnswer with valid JSON only."


def prompts(spark: SparkSession, template_path: str, requests: DataFrame, placeholder: str, fallback: str) -> DataFrame:
    """``requests(text)`` and ``prompt``: the template file (or the fallback where there is none) with the text filled in."""
    from tessera.sources.tables import exists

    template = spark.read.text(template_path, wholetext=True).first()["value"] if exists(spark, template_path) else fallback
    return requests.withColumn("prompt", fill_prompt(F.lit(template), placeholder, F.coalesce("text", F.lit(""))))


def versioned(root: str, version: str, name: str) -> str:
    """Where a prompt of that name and version is; the version is a setting, so an older one stays usable."""
    return f"{root.rstrip('/')}/{version}/{name}.txt"


def ask(url: str, model: str) -> Callable[[str], str]:
    def call(prompt: str) -> str:
        body = json.dumps({"model": model, "prompt": prompt, "stream": False, "format": "json"}).encode()
        request = urllib.request.Request(f"{url}/api/generate", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=SECONDS) as answer:
            return json.load(answer)["response"]

    return call


def complete(rows: DataFrame, call: Callable[[str], str], at_once: int = 4) -> DataFrame:
    """``rows(id, prompt)`` -> ``id, answer, attempts, error``. At most ``at_once`` requests run at a time; after a failure the
    prompt asks for JSON again, three attempts in all; an error is a value."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, prompt in zip(frame["id"], frame["prompt"], strict=True):
                answer = error = None
                n = 0
                while n < ATTEMPTS and answer is None:
                    n += 1
                    try:
                        text = call(prompt + (REPAIR if n > 1 else ""))
                        json.loads(text)
                        answer = text
                    except Exception as e:  # noqa: BLE001  reported with the row
                        error = f"{type(e).__name__}: {e}"[:500]
                out.append((key, answer, n, None if answer is not None else error))
            yield pd.DataFrame(out, columns=["id", "answer", "attempts", "error"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "prompt").repartition(at_once).mapInPandas(run, f"id {kind}, answer string, attempts int, error string")


def probe(spark: SparkSession, url: str, wanted: list[str], seconds: float = 5.0) -> DataFrame:
    """One row per wanted model: whether the server answers and has it."""
    try:
        with urllib.request.urlopen(f"{url}/api/tags", timeout=seconds) as answer:
            names, up = [m["name"] for m in json.load(answer).get("models", [])], True
    except OSError:
        names, up = [], False
    rows = spark.createDataFrame([(w, up, names) for w in wanted], "model string, reachable boolean, available array<string>")
    return rows.withColumn("installed", model_installed(F.col("available"), F.col("model")))
