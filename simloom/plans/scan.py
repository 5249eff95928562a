"""The scan: blocks to features to pairs with scores to ranked pairs, one lazy plan."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.config import Settings
from simloom.errors import NoFilesError
from simloom.functions.signatures import BITS
from simloom.operators import features, fuzzy, meetings, ranking, score, synonyms
from simloom.sources import files
from simloom.sources.extract import extract_blocks
from simloom.storage import written


def rule(settings: Settings, cross_file: bool = True, least: float | None = None) -> meetings.Rule:
    """The filters and the score of a scan; pairs from ``least`` on, the threshold if not given."""
    distance = settings.simhash_max_distance
    if distance is not None:
        # The estimate of a distance must come near the threshold (``candidates.estimate_ok``).
        distance = max((d for d in range(min(distance, BITS) + 1) if (BITS - d) / BITS >= 0.3 * settings.threshold), default=-1)
    return meetings.Rule(distance, cross_file=cross_file, penalty=settings.frequency_penalty, overlap=True, least=settings.threshold if least is None else least)


def block_table(blocks: DataFrame, names: bool = False) -> DataFrame:
    return written(features.block_features(blocks, names), "features")


def score_blocks(blocks: DataFrame, settings: Settings, edges: DataFrame | None = None, cross_file: bool = True, report: meetings.Report | None = None) -> DataFrame:
    """All pairs of blocks that reach the threshold, with files, lines and similarity.

    ``report`` may leave out pairs that a later step needs not (``meetings.best_rows``).
    """
    kept = rule(settings, cross_file)
    if settings.fuzzy_identifiers:
        # Below half the threshold there is no second pass.
        edges = synonyms.small_dictionary(blocks.sparkSession) if edges is None else edges
        second = fuzzy.second_pass(edges, settings.threshold, settings.frequency_penalty, settings.fuzzy_identifier_threshold)
        kept = replace(rule(settings, cross_file, 0.5 * settings.threshold), second=second)
    featured = block_table(blocks, settings.fuzzy_identifiers)
    return meetings.met(featured, None, kept, report or meetings.block_rows(), score.SCORED, score.CARRIED).drop("ab", "ba")


def match_corpora(left: DataFrame, right: DataFrame, settings: Settings) -> DataFrame:
    """Pairs across two sets of blocks, ``id_a`` from the left one; ids may occur in both."""
    a, b = block_table(left), block_table(right)
    return meetings.met(a, b, rule(settings), meetings.block_rows(across=True), score.SCORED, score.CARRIED).drop("ab", "ba")


def similar_files(blocks: DataFrame, settings: Settings, edges: DataFrame | None = None) -> DataFrame:
    """The best pair of blocks of each pair of files, most similar first."""
    return ranking.ranked(ranking.best_per_file_pair(score_blocks(blocks, settings, edges, report=meetings.best_rows)))


def similar_within_files(blocks: DataFrame, settings: Settings) -> DataFrame:
    """Pairs within one file; empty unless the extension is switched on."""
    pairs = score_blocks(blocks, settings, cross_file=False).where("file_a = file_b")
    apart = (F.col("end_line_a") < F.col("start_line_b")) | (F.col("end_line_b") < F.col("start_line_a"))
    on = settings.check_intra_file and settings.intra_file_extension
    return pairs.where(apart).where(F.lit(on))


def scan(spark: SparkSession, settings: Settings, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scans ``settings.paths``: the ranked pairs, and the sources (file, text).

    A path with a scheme (``store://folder``) is listed and filtered by Spark; others
    are local files and folders.
    """
    roots = settings.paths or (".",)
    stores = [r for r in roots if "://" in r]
    found = files.discover([r for r in roots if r not in stores], settings)
    sources = files.read_files(spark, found)
    for root in stores:
        sources = sources.unionByName(files.read_folder(spark, root, settings))
    if not found and (not stores or sources.isEmpty()):
        raise NoFilesError("no files to scan")
    return similar_files(extract_blocks(sources, settings.min_block_tokens), settings, edges), sources
