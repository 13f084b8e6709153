"""Schemas of landed catalogue records and library tables."""

from __future__ import annotations

from pyspark.sql import types as T


def parse(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


NAMED = "struct<id: bigint, name: string>"
IMAGE = "struct<id: bigint, url: string>"
PLATFORM = f"struct<id: bigint, name: string, platform_logo: {IMAGE}>"

GAMES = f"""
id bigint, name string, summary string, storyline string, first_release_date bigint, genres array<{NAMED}>, platforms array<{PLATFORM}>,
cover struct<url: string>, screenshots array<{IMAGE}>, artworks array<{IMAGE}>,
involved_companies array<struct<id: bigint, company: {NAMED}, publisher: boolean>>, rating double, aggregated_rating double, total_rating double,
follows bigint, hypes bigint, game_localizations array<struct<id: bigint, name: string, region: bigint>>,
language_supports array<struct<id: bigint, language: {NAMED}, language_support_type: {NAMED}>>, similar_games array<{NAMED}>,
franchise {NAMED}, collection {NAMED}, version_parent bigint, category int, status int
"""
PLATFORMS = f"id bigint, name string, abbreviation string, platform_logo {IMAGE}"
GENRES = "id bigint, name string"
GAME_COPY = f"struct<id: bigint, name: string, genres: array<{NAMED}>, platforms: array<{PLATFORM}>, first_release_date: bigint, summary: string, cover: struct<url: string>, total_rating: double>"
PLAYER = "struct<status: string, hours_played: double, rating: double, review: string>"
BACKLOGS = f"_id string, userId string, categories array<string>, igdb_data {GAME_COPY}, player_data {PLAYER}, createdAt timestamp, updatedAt timestamp"
CATEGORIES = "_id string, name string, userId string"
USERS = "_id string, username string, email string, password string, createdAt timestamp, updatedAt timestamp"

SCHEMAS = {"games": GAMES, "platforms": PLATFORMS, "genres": GENRES, "backlogs": BACKLOGS, "categories": CATEGORIES, "users": USERS}
