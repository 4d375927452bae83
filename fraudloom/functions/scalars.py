"""Row-level column functions; all stay inside JVM code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fraudloom.config import LEVEL_RANK

# --- fixed values -----------------------------------------------------------
ID_PATTERN = r"^[A-Za-z0-9_\-.:]{1,64}$"
IP_PATTERN = r"^[0-9a-fA-F:.]{3,45}$"
MARKUP_PATTERN = r"(?i)<[^>]+>|(?:javascript|data):"
SCRIPT_TOKENS = ["curl", "python", "headless", "scrapy", "wget", "bot"]
MOBILE_TOKENS = ["iphone", "android", "mobile"]
DESKTOP_TOKENS = ["windows", "macintosh", "x11"]
# --- end of fixed values ----------------------------------------------------


def is_ipv4(ip: Column) -> Column:
    return F.size(F.split(ip, r"\.")) == 4


def mask_ip(ip: Column) -> Column:
    """IPv4 keeps its first two parts; anything else keeps nine characters."""
    parts = F.split(ip, r"\.")
    short = F.when(F.length(ip) > 9, F.concat(F.substring(ip, 1, 9), F.lit("…"))).otherwise(ip)
    return F.when(is_ipv4(ip), F.concat(parts[0], F.lit("."), parts[1], F.lit(".x.x"))).otherwise(short)


def hash_ip(ip: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), ip), 256), 1, 16)


def subnet24(ip: Column) -> Column:
    """First three parts of an IPv4 address, null otherwise."""
    return F.when(is_ipv4(ip), F.array_join(F.slice(F.split(ip, r"\."), 1, 3), "."))


def contains_any(text: Column, tokens: Sequence[str]) -> Column:
    found = F.lit(False)
    for token in tokens:
        found = found | text.contains(token)
    return found


def is_bot_agent(agent: Column, tokens: Sequence[str]) -> Column:
    text = F.lower(F.coalesce(agent, F.lit("")))
    return (text == "") | contains_any(text, tokens)


def device_type(agent: Column) -> Column:
    text = F.lower(agent)
    return (F.when(contains_any(text, SCRIPT_TOKENS), "Bot/script")
            .when(contains_any(text, MOBILE_TOKENS), "Mobile")
            .when(contains_any(text, DESKTOP_TOKENS), "Desktop").otherwise("Unknown"))


def log1p_clipped(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def clean_text(text: Column, limit: int = 400) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), MARKUP_PATTERN, ""), r"\x00", "")
    return F.substring(F.regexp_replace(bare, r"^\s+|\s+$", ""), 1, limit)


def clean_name(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9 _\-]", "")), 1, 60)


def clean_notes(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1f]", " ")), 1, 400)


def clean_tags(text: Column) -> Column:
    """At most ten tags of 20 word characters, comma separated."""
    tags = F.transform(F.split(F.coalesce(text, F.lit("")), ","),
                       lambda t: F.substring(F.regexp_replace(t, r"[^A-Za-z0-9_\-]", ""), 1, 20))
    return F.array_join(F.slice(F.filter(tags, lambda t: t != ""), 1, 10), ",")


def level_rank(level: Column) -> Column:
    rank = F.when(level == "LOW", LEVEL_RANK["LOW"])
    for name in ("MEDIUM", "HIGH", "CRITICAL"):
        rank = rank.when(level == name, LEVEL_RANK[name])
    return rank


def is_flagged(action: Column) -> Column:
    return action.isin("FLAG", "BLOCK")


def flagged_sum(action: Column) -> Column:
    return F.sum(F.when(is_flagged(action), 1).otherwise(0))
