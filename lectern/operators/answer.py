"""From search results to answers: context, prompt, generation, post-processing."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import answer_text, capitalised, final_answer, parsed_response, prompt_text, strip
from lectern.operators.neardup import fuzzy_results
from lectern.operators.search import Index, search
from lectern.options import SearchOptions

TEMPLATE = (
    "Answer the question from the context alone, as JSON with the keys answer, confidence_score and need_api.\n\n"
    "Context: {context}\n\nEarlier results: {api_response}\n\nQuestion: {query}\n\nAnswer:"
)
NO_ANSWER = "No answer found."
EMPTY_SOURCES = "The document appears to be empty."


class Generator(Protocol):
    """Picklable; returns a model's response to a prompt."""

    def generate(self, prompt: str) -> str: ...


class ExtractiveGenerator:
    """Deterministic stand-in: the context sentence that shares most words with the question."""

    def generate(self, prompt: str) -> str:
        body = re.search(r"Context: (.*?)\n\n(?:Earlier results|Question):", prompt, re.S)
        asked = re.search(r"Question: (.*?)\n\nAnswer:", prompt, re.S)
        wanted = set(re.findall(r"\w+", asked[1].lower() if asked else ""))
        best, most = "", 0
        for s in re.split(r"(?<=[.!?])\s+", body[1] if body else ""):
            n = len(wanted & set(re.findall(r"\w+", s.lower())))
            if n > most:
                best, most = s.strip(), n
        return best


def retrieved(index: Index, queries: DataFrame, strategy: str = "ensemble", ratio: float = 85) -> DataFrame:
    """Results for answering, without fuzzy repeats: 16 for the ensemble, 8 (semantic: up to 24) else."""
    o = SearchOptions(top_k=16 if strategy == "ensemble" else 8)
    return fuzzy_results(search(index, queries, strategy, o), ratio)


def context(results: DataFrame, chunk_type: Column | None = None) -> DataFrame:
    """(query_id, context): numbered results in order of rank, as one paragraph."""
    kind = F.lit("unknown") if chunk_type is None else F.coalesce(chunk_type, F.lit("unknown"))
    line = F.concat(F.lit("[Chunk "), F.col("rank").cast("string"), F.lit(" - "), kind, F.lit("]: "), F.col("content"))
    listed = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    return listed.select("query_id", prompt_text(F.array_join(F.transform("x", lambda r: r["line"]), "\n\n")).alias("context"))


def prompt(query: Column, context_: Column, api_response: Column | None = None, template: str = TEMPLATE) -> Column:
    """The template's marks replaced in one pass each; the context last, so that nothing in it is replaced."""
    t = F.replace(F.lit(template), F.lit("{query}"), F.coalesce(query, F.lit("")))
    t = F.replace(t, F.lit("{api_response}"), F.coalesce(F.lit("") if api_response is None else api_response, F.lit("")))
    return F.replace(t, F.lit("{context}"), F.coalesce(context_, F.lit("")))


def generated(
    prompts: DataFrame, generator: Generator, tool: Callable[[str], str] | None = None, attempts: int = 5, steps: int = 5
) -> DataFrame:
    """(query_id, response, error) of (query_id, prompt).

    A failing call is tried again; a response that asks for a tool is fed the
    tool's result and asked again, if a tool is given (none by default: the
    address would be the model's choice).
    """

    def answer(text: str) -> tuple[str | None, str | None]:
        import json

        error = None
        for _ in range(attempts):
            try:
                said = generator.generate(text)
                for _ in range(steps - 1):
                    try:
                        need = json.loads(said).get("need_api")
                    except (ValueError, AttributeError):
                        break
                    if tool is None or not isinstance(need, dict):
                        break
                    said = generator.generate(f"{text}\n\nTool result: {tool(json.dumps(need))}\nPrevious answer: {said}")
                return said, None
            except Exception as e:  # noqa: BLE001  one question's failure is that question's error row
                error = f"{type(e).__name__}: {e}"
        return None, error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            said = [answer(p) for p in f["prompt"]]
            yield pd.DataFrame({"query_id": f["query_id"], "response": [a for a, _ in said], "error": [e for _, e in said]})

    kind = prompts.schema["query_id"].dataType.simpleString()
    return prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, response string, error string")


def finished_answer(response: Column) -> Column:
    """A response as shown: parsed, in one line, capitalised."""
    parsed = parsed_response(response)
    return answer_text(final_answer(capitalised(strip(parsed["answer"]))))


def answers(index: Index, queries: DataFrame, strategy: str = "ensemble", generator: Generator | None = None) -> DataFrame:
    """(query_id, answer, confidence_score) of every query, also of those without results."""
    found = context(retrieved(index, queries, strategy))
    asked = queries.join(found, "query_id", "left").select("query_id", prompt(F.col("query"), F.col("context")).alias("prompt"))
    said = generated(asked, generator or ExtractiveGenerator())
    parsed = parsed_response(F.col("response"))
    text = F.when(F.col("error").isNotNull(), F.concat(F.lit("Processing error: "), F.col("error"))).otherwise(
        F.when(parsed["valid"], finished_answer(F.col("response")))
    )
    out = queries.select("query_id").join(said, "query_id", "left")
    return out.select(
        "query_id", F.coalesce(F.when(text != "", text), F.lit(NO_ANSWER)).alias("answer"), F.coalesce(parsed["confidence_score"], F.lit(0.5)).alias("confidence_score")
    )
