"""The library's entry points, over any number of papers at once.

Where a toolkit for one file raises, these return rows with a status; arguments are still checked and raise.
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import layout, lookup
from .plans import preview
from .plans import questions as plan
from .plans.split import split_papers
from .session import stored
from .sources import papers as source
from .sources import sink

FILE_TYPES = ("hwp", "hwpx")
PREVIEWS = ("page", "question")
MEDIA = ("svg", "png", "pdf")


def _choice(value: str, allowed: tuple[str, ...], what: str) -> str:
    got = value.strip().lower()
    if got not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}, not {value!r}")
    return got


def parse_file_type(value: str) -> str:
    return _choice(value, FILE_TYPES, "file type")


def infer_file_type_from_path(path: str) -> str:
    return _choice(PurePosixPath(path).suffix.removeprefix("."), FILE_TYPES, "extension")


def parse_preview_type(value: str) -> str:
    return _choice(value, PREVIEWS, "preview type")


def parse_media_type(value: str) -> str:
    return _choice(value, MEDIA, "media type")


def import_files(spark: SparkSession, path: str) -> DataFrame:
    """Papers under ``path``: one row per file with its parts and status."""
    return source.read_papers(spark, path)


def save_files(papers: DataFrame, folder: str, file_type: str = "hwpx") -> DataFrame:
    """Writes a package per paper when the result is read: (doc_id, path, size, error).  Only HWPX can be written."""
    if parse_file_type(file_type) != "hwpx":
        return sink.as_hwp(papers)
    return sink.write_packages(papers, folder)


def hwp_to_hwpx(papers: DataFrame) -> DataFrame:
    return sink.as_hwpx(papers)


def hwpx_to_hwp(papers: DataFrame) -> DataFrame:
    return sink.as_hwp(papers)


def split_set_to_question(papers: DataFrame) -> DataFrame:
    """A paper for each question or passage set: rows as ``import_files`` gives them, path ``stem_qNN``, with its label."""
    return split_papers(papers)


def extract_questions(papers: DataFrame) -> DataFrame:
    """(doc_id, unit_no, label, subject, text, images) of every paper that a subject and questions were found in."""
    return plan.questions(stored(papers))


def is_corrupt(papers: DataFrame) -> DataFrame:
    return papers.select("doc_id", (F.col("status") == "corrupt").alias("is_corrupt"))


def prepare_fonts(papers: DataFrame, manifest: DataFrame, present: DataFrame) -> DataFrame:
    """(face, file) that previews of ``papers`` would miss; manifest: face, file; present: file."""
    faces = source.part(papers, "fonts").select("doc_id", F.col("name").alias("face"))
    return lookup.missing_faces(lookup.required_faces(faces), manifest, present)


def export_preview(papers: DataFrame, folder: str, preview_type: str = "page", media: str = "svg") -> DataFrame:
    """(doc_id, page, path): SVG pages of the papers' stored lines, or an image a question, written when the result is read.

    Other media need a rasterizer.
    """
    if parse_media_type(media) != "svg":
        raise NotImplementedError("only SVG can be written here")
    kind = parse_preview_type(preview_type)
    things = preview.page_things(papers) if kind == "page" else preview.question_things(papers)
    pages = layout.page_svg(things).withColumn("name", F.format_string("%s_%s%02d.svg", "doc_id", F.lit(kind[0]), F.col("page") + 1))
    return sink.write_texts(pages, folder, "name", "svg")
