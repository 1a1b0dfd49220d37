"""Demonstration networks.

Small public networks are given as edge lists; larger ones are read from the collections' own files with ``readers``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..graph import Bipartite, Graph, bipartite, from_edges
from .readers import read_konect, read_pajek

# Published edge lists.
TARO_EXCHANGE = [
    (1, 2), (1, 3), (1, 4), (2, 1), (2, 4), (2, 5), (3, 1), (3, 6), (3, 7), (3, 9), (3, 10), (4, 1), (4, 2), (4, 5), (4, 12), (4, 19), (4, 22), (5, 2),
    (5, 4), (5, 6), (6, 3), (6, 5), (6, 7), (6, 8), (7, 3), (7, 6), (7, 8), (8, 6), (8, 7), (8, 11), (8, 12), (8, 13), (9, 3), (9, 10), (9, 17), (10, 3),
    (10, 9), (10, 17), (11, 8), (11, 14), (11, 15), (12, 4), (12, 8), (12, 21), (13, 8), (13, 18), (13, 22), (14, 11), (14, 15), (14, 16), (15, 11), (15,
    14), (15, 17), (16, 14), (16, 18), (16, 20), (17, 9), (17, 10), (17, 15), (17, 18), (17, 19), (18, 13), (18, 16), (18, 17), (18, 20), (18, 21), (19,
    4), (19, 17), (19, 22), (20, 16), (20, 18), (20, 21), (21, 12), (21, 18), (21, 20), (22, 4), (22, 13), (22, 19)
]
MASPALOMAS = [
    (1, 8), (1, 12), (1, 20), (1, 24), (2, 9), (2, 12), (2, 19), (2, 21), (2, 24), (3, 15), (3, 21), (3, 24), (4, 16), (4, 21), (4, 24), (5, 15), (5, 21),
    (5, 24), (6, 15), (6, 16), (6, 21), (6, 24), (7, 8), (7, 20), (7, 24), (8, 9), (8, 12), (8, 20), (8, 24), (9, 10), (9, 20), (9, 21), (9, 24), (10,
    17), (10, 18), (10, 21), (10, 24), (11, 13), (11, 21), (11, 24), (12, 17), (12, 21), (12, 24), (13, 14), (13, 15), (13, 17), (13, 18), (13, 21), (13,
    24), (14, 17), (14, 21), (14, 24), (15, 17), (15, 21), (15, 24), (16, 21), (16, 23), (16, 24), (17, 21), (17, 24), (18, 17), (18, 21), (18, 24), (19,
    7), (19, 8), (19, 23), (20, 9), (20, 10), (20, 12), (20, 19), (20, 21), (21, 11), (21, 13), (21, 15), (21, 18), (21, 23), (22, 1), (22, 2), (22, 3),
    (22, 4), (22, 5), (22, 6)
]
CHESAPEAKE_BAY = [
    (1, 7), (1, 8), (1, 11), (1, 12), (1, 13), (1, 22), (1, 23), (1, 34), (1, 35), (1, 39), (2, 7), (2, 8), (2, 9), (2, 11), (2, 12), (2, 13), (2, 22),
    (2, 23), (2, 35), (2, 36), (2, 39), (3, 14), (3, 15), (3, 16), (3, 17), (3, 18), (3, 36), (3, 39), (4, 17), (4, 36), (4, 39), (5, 6), (5, 35), (5,
    39), (6, 7), (6, 35), (6, 39), (7, 8), (7, 9), (7, 11), (7, 12), (7, 13), (7, 35), (7, 39), (8, 9), (8, 10), (8, 20), (8, 21), (8, 22), (8, 23), (8,
    24), (8, 35), (8, 38), (8, 39), (9, 10), (9, 35), (9, 36), (9, 39), (10, 35), (10, 36), (10, 39), (11, 19), (11, 36), (11, 39), (12, 19), (12, 26),
    (12, 36), (12, 38), (12, 39), (13, 36), (13, 38), (13, 39), (14, 25), (14, 26), (14, 27), (14, 28), (14, 29), (14, 36), (14, 39), (15, 19), (15, 25),
    (15, 26), (15, 27), (15, 28), (15, 29), (15, 36), (15, 39), (16, 19), (16, 27), (16, 36), (16, 39), (17, 36), (17, 39), (18, 19), (18, 25), (18, 26),
    (18, 27), (18, 29), (18, 32), (18, 36), (18, 39), (19, 19), (19, 33), (19, 36), (19, 38), (19, 39), (20, 36), (20, 38), (20, 39), (21, 33), (21, 36),
    (21, 38), (21, 39), (22, 27), (22, 28), (22, 30), (22, 31), (22, 32), (22, 33), (22, 36), (22, 38), (22, 39), (23, 30), (23, 32), (23, 33), (23, 36),
    (23, 38), (23, 39), (24, 36), (24, 38), (24, 39), (25, 36), (25, 38), (25, 39), (26, 36), (26, 38), (26, 39), (27, 30), (27, 36), (27, 38), (27, 39),
    (28, 36), (28, 38), (28, 39), (29, 36), (29, 38), (29, 39), (30, 36), (30, 38), (30, 39), (31, 32), (31, 36), (31, 38), (31, 39), (32, 36), (32, 38),
    (32, 39), (33, 36), (33, 38), (33, 39), (34, 5), (35, 2), (35, 7), (35, 8), (35, 9), (35, 11), (35, 12), (35, 13), (35, 22), (35, 23), (35, 36), (36,
    3), (36, 19), (37, 1), (37, 4), (37, 34), (37, 35)
]
CORPORATE_CLUB = [
    (1, 26), (1, 27), (1, 28), (2, 26), (2, 29), (3, 26), (3, 30), (3, 31), (4, 26), (4, 32), (4, 33), (5, 26), (5, 30), (5, 33), (6, 26), (6, 34), (6,
    35), (6, 36), (7, 28), (7, 34), (7, 35), (8, 34), (8, 35), (8, 37), (8, 38), (9, 26), (9, 39), (10, 26), (10, 30), (10, 39), (11, 28), (11, 34), (12,
    26), (12, 27), (12, 34), (12, 39), (13, 26), (13, 29), (13, 30), (13, 31), (13, 32), (13, 34), (13, 36), (14, 26), (14, 30), (14, 31), (14, 32), (14,
    40), (15, 26), (15, 30), (15, 33), (15, 38), (15, 40), (16, 26), (16, 27), (16, 29), (16, 30), (16, 31), (16, 36), (17, 29), (17, 31), (17, 32), (17,
    34), (17, 39), (18, 26), (18, 28), (18, 34), (18, 37), (18, 39), (19, 26), (19, 30), (19, 31), (19, 34), (19, 36), (20, 26), (20, 34), (20, 38), (21,
    26), (21, 31), (21, 38), (22, 26), (22, 30), (22, 31), (22, 40), (23, 26), (23, 31), (23, 34), (23, 37), (23, 40), (24, 26), (24, 30), (24, 32), (25,
    26), (25, 29), (25, 30)
]
RHESUS_MACAQUES = [
    (1, 2, 3), (1, 3, 4), (2, 1, 49), (2, 3, 41), (2, 4, 3), (2, 9, 3), (2, 10, 2), (2, 11, 1), (2, 12, 6), (2, 15, 9), (2, 16, 1), (3, 1, 25), (3, 2, 8),
    (3, 9, 5), (3, 10, 1), (3, 11, 9), (3, 12, 2), (3, 13, 2), (3, 15, 21), (4, 2, 1), (5, 3, 2), (5, 6, 15), (5, 7, 8), (5, 8, 2), (5, 9, 1), (5, 10, 9),
    (5, 11, 3), (5, 12, 1), (5, 13, 4), (5, 14, 2), (6, 1, 17), (6, 3, 1), (6, 5, 5), (6, 8, 8), (6, 10, 4), (6, 12, 3), (6, 15, 1), (7, 2, 1), (7, 5, 5),
    (7, 8, 2), (7, 9, 2), (7, 14, 11), (8, 6, 11), (8, 7, 1), (9, 2, 4), (9, 3, 6), (9, 11, 4), (9, 13, 2), (9, 14, 6), (9, 15, 1), (10, 1, 1), (10, 2,
    4), (10, 3, 4), (10, 5, 5), (10, 6, 3), (10, 9, 2), (10, 11, 8), (10, 12, 5), (10, 13, 16), (10, 15, 11), (11, 1, 5), (11, 2, 9), (11, 3, 7), (11, 5,
    1), (11, 9, 4), (11, 10, 1), (11, 13, 1), (11, 15, 10), (11, 16, 5), (12, 2, 3), (12, 3, 24), (12, 5, 2), (12, 6, 1), (12, 8, 3), (12, 10, 4), (12,
    11, 5), (12, 13, 2), (12, 14, 1), (12, 15, 25), (13, 1, 1), (13, 3, 9), (13, 5, 2), (13, 9, 2), (13, 10, 21), (13, 11, 3), (13, 12, 4), (13, 15, 5),
    (14, 2, 1), (14, 3, 1), (14, 4, 3), (14, 7, 1), (14, 8, 1), (14, 9, 8), (14, 10, 1), (14, 12, 5), (14, 13, 1), (14, 15, 2), (15, 2, 6), (15, 3, 23),
    (15, 4, 1), (15, 10, 4), (15, 11, 13), (15, 12, 2), (15, 14, 1), (15, 16, 4), (16, 2, 2), (16, 3, 2), (16, 9, 1), (16, 11, 3), (16, 12, 1), (16, 15,
    3)
]
# Degrees of the karate club network.
KARATE_DEGREES = [16, 9, 10, 6, 3, 4, 4, 4, 5, 2, 3, 1, 2, 5, 2, 2, 2, 2, 2, 3, 2, 2, 2, 5, 3, 3, 2, 4, 3, 4, 4, 6, 12, 17]


def _digraph(spark: SparkSession, pairs: list[tuple[int, int]], n: int) -> Graph:
    return from_edges(spark.createDataFrame(pairs, "src long, dst long"), True, spark.range(1, n + 1))


def taro_exchange(spark: SparkSession) -> Graph:
    """Gifts between 22 households, all returned."""
    return _digraph(spark, TARO_EXCHANGE, 22)


def maspalomas(spark: SparkSession) -> Graph:
    """Food web, 24 nodes."""
    return _digraph(spark, MASPALOMAS, 24)


def chesapeake_bay(spark: SparkSession) -> Graph:
    """Food web, 39 nodes."""
    return _digraph(spark, CHESAPEAKE_BAY, 39)


def rhesus_macaques(spark: SparkSession) -> Graph:
    """Grooming episodes between 16 macaques; whole-number weights."""
    return from_edges(spark.createDataFrame(RHESUS_MACAQUES, "src long, dst long, w long"), True, spark.range(1, 17), weight="w")


def corporate_club(spark: SparkSession) -> Bipartite:
    """Memberships of 25 persons in 15 organisations."""
    return bipartite(spark.createDataFrame(CORPORATE_CLUB, "bottom long, top long"), bottoms=spark.range(1, 26), tops=spark.range(26, 41))


def everglades(spark: SparkSession, path: str) -> Graph:
    return read_pajek(spark, path)


def florida(spark: SparkSession, path: str) -> Graph:
    return read_pajek(spark, path)


def st_marks(spark: SparkSession, path: str) -> Graph:
    return read_pajek(spark, path)


def little_rock(spark: SparkSession, path: str) -> Graph:
    return read_konect(spark, path)
