"""Attachment of models and services: injected callables that work on batches, loaded once per Python worker.

A callable is given as a factory; it runs in the tasks, so nothing of it passes through the driver.  An error becomes the row's
error and never fails the job.  Use ``repartition(n)`` before these to bound the number of calls in flight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import build_prompt, parse_model_json, strip_markdown
from ..sources.files import kept

TOKEN = "pos int, start int, end int, label string, confidence double"


def predict_tokens(df: DataFrame, load: Callable[[], Callable[[list[str]], list[list[tuple]]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token rows (doc_id, pos, start, end, label, confidence) of a tagger, for ``decode_bio``.

    ``load()`` gives a function from texts to a list of (start, end, label, confidence) for each; null texts have no tokens.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = load()
        for b in batches:
            found = tagger(b["text"].tolist())
            rows = [(i, k, *t) for i, tokens in zip(b["doc_id"], found, strict=True) for k, t in enumerate(tokens)]
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "start", "end", "label", "confidence"])

    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    return texts.mapInPandas(run, f"doc_id {kind}, {TOKEN}")


def _asked(df: DataFrame, providers: list[tuple[str, Callable]]) -> DataFrame:
    """Answers in one pass over (doc_id, document_type, prompt): of each batch, what a provider fails at goes to the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calls = {}
        for b in batches:
            prompts = b.column("prompt").to_pylist()
            out = [None] * len(prompts)
            left = range(len(prompts))
            for k, (name, load) in enumerate(providers):
                if left and k not in calls:  # a model that nothing is asked of is not loaded
                    calls[k] = load()
                failed = []
                for i in left:
                    try:
                        out[i] = (name, calls[k](prompts[i]), None)
                    except Exception as e:  # the row keeps what went wrong
                        out[i] = (name, None, f"{type(e).__name__}: {e}")
                        failed.append(i)
                left = failed
            answers = [pa.array([x[c] for x in out], pa.string()) for c in range(3)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("document_type"), *answers], ["doc_id", "document_type", "model_used", "raw_response", "error"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, document_type string, model_used string, raw_response string, error string")


def extract_with_model(df: DataFrame, schema_json: str, providers: list[tuple[str, Callable]], id_col: str = "doc_id", text_col: str = "text", type_col: str = "document_type") -> DataFrame:
    """(doc_id, document_type, metadata, model_used, raw_response, error): the first provider that answers.

    ``providers`` are (name, load) in order; a row that failed goes to the next one in the same task, so a prompt is sent to
    Python once, whatever its providers.  The answers are written once, without the prompts, so a row is asked once of each
    and every row comes out.  ``metadata`` is the JSON object of the answer as a string, an empty one where there is none.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(type_col).alias("document_type"), build_prompt(F.col(text_col), schema_json, F.col(type_col)).alias("prompt")).filter("prompt IS NOT NULL")
    done = kept(_asked(rows, providers))
    metadata = F.coalesce(parse_model_json(strip_markdown(F.col("raw_response"))), F.lit("{}"))
    return done.select("doc_id", "document_type", metadata.alias("metadata"), "model_used", "raw_response", "error")


def ocr_pages(pages: DataFrame, load: Callable[[], Callable[[bytes], str]], provider: str = "ocr") -> DataFrame:
    """(doc_id, page_number, provider, extracted_text, status, error) of page images (doc_id, page_number, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = load()
        for b in batches:
            out = []
            for content in b["content"]:
                try:
                    out.append((read(content), "success", None))
                except Exception as e:
                    out.append(("", "failed", f"{type(e).__name__}: {e}"))
            own = b[["doc_id", "page_number"]].assign(provider=provider)
            yield own.assign(extracted_text=[x[0] for x in out], status=[x[1] for x in out], error=[x[2] for x in out])

    kind = pages.schema["doc_id"].dataType.simpleString()
    return pages.select("doc_id", "page_number", "content").mapInPandas(run, f"doc_id {kind}, page_number int, provider string, extracted_text string, status string, error string")


def read_pages_of(files: DataFrame, load: Callable[[], Callable[[bytes], Iterator[bytes]]]) -> DataFrame:
    """U4: (doc_id, page_number from 1, content, error) of documents (path, content); one that cannot be read is page 0 with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = load()
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    pages = list(render(content))
                except Exception as e:
                    yield pd.DataFrame({"doc_id": [path], "page_number": [0], "content": [None], "error": [f"{type(e).__name__}: {e}"]})
                    continue
                yield pd.DataFrame({"doc_id": [path] * len(pages), "page_number": range(1, len(pages) + 1), "content": pages, "error": None})

    return files.select("path", "content").mapInPandas(run, "doc_id string, page_number int, content binary, error string")
