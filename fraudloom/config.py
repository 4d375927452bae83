"""Engine configuration and the published constants results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

SECOND = 1_000_000  # every event time is a bigint of epoch microseconds

# --- fixed values -----------------------------------------------------------
# Feature order of the dense vector.
FEATURES = [
    "clicks_10s", "clicks_1m", "clicks_5m", "clicks_1h",
    "avg_interval", "min_interval", "interval_std", "interval_cv", "timing_entropy", "burst_score",
    "unique_ads_1h", "repeat_ad_ratio",
    "device_clicks_1m", "unique_users_per_device", "unique_ips_per_device",
    "ip_clicks_1m", "unique_devices_per_ip", "unique_users_per_ip",
    "campaign_click_share_5m", "geo_user_countries", "geo_ip_countries",
    "ua_bot_flag", "account_age_days",
]

# Display label of each feature.
FEATURE_LABELS = {
    "clicks_10s": "Clicks in last 10s", "clicks_1m": "Click velocity (1 min)",
    "clicks_5m": "Clicks in last 5 min", "clicks_1h": "Clicks in last hour",
    "avg_interval": "Average click interval", "min_interval": "Shortest click interval",
    "interval_std": "Click interval variability", "interval_cv": "Click timing regularity (CV)",
    "timing_entropy": "Timing entropy", "burst_score": "Burst intensity",
    "unique_ads_1h": "Distinct ads clicked (1h)", "repeat_ad_ratio": "Repeated-ad ratio",
    "device_clicks_1m": "Device clicks (1 min)", "unique_users_per_device": "Users sharing device",
    "unique_ips_per_device": "IPs used by device", "ip_clicks_1m": "IP clicks (1 min)",
    "unique_devices_per_ip": "Devices behind IP", "unique_users_per_ip": "Users behind IP",
    "campaign_click_share_5m": "Campaign traffic share", "geo_user_countries": "Countries per user (1h)",
    "geo_ip_countries": "Countries per IP (1h)", "ua_bot_flag": "Automation user-agent",
    "account_age_days": "Account age (days)",
}

# Upper edges, in seconds, of the gap histogram behind the timing entropy.
INTERVAL_EDGES = [0.1, 0.5, 1, 2, 5, 10, 30, 60, 120, 300, 600, 1800, 3600]

# User-agent tokens that mark automation.
BOT_TOKENS = ["curl", "python-requests", "headless", "bot", "spider", "scrapy", "selenium", "phantomjs", "wget"]

# Weight of each rule.
RULE_WEIGHTS = {
    "high_click_velocity": 0.90, "tiny_interval": 0.90, "bot_user_agent": 0.60, "blocked_ip": 1.00,
    "impossible_geo": 0.70, "device_sharing": 0.80, "ip_device_fanin": 0.80, "repeat_ad": 0.70,
}

# Limits the rules compare with.
RULE_LIMITS = {
    "max_clicks_per_min": 30, "min_interval_s": 0.25, "min_interval_clicks": 5, "max_users_per_device": 4,
    "max_devices_per_ip": 6, "repeat_ad_ratio": 0.9, "repeat_ad_min_clicks": 20,
}

# Fusion: layer weights, level limits, and the action per level.
LAYER_WEIGHTS = {"rules": 0.30, "ml": 0.45, "online": 0.10, "anomaly": 0.15}
LEVEL_LIMITS = {"CRITICAL": 0.90, "HIGH": 0.70, "MEDIUM": 0.30}
LEVEL_RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}
ACTIONS = {"LOW": "ALLOW", "MEDIUM": "MONITOR", "HIGH": "FLAG", "CRITICAL": "BLOCK"}

# Cost per click by campaign.
CAMPAIGN_CPC = {"C10": 12.0, "C11": 8.5, "C12": 15.0, "C13": 7.0, "C14": 10.5, "C15": 9.0}
DEFAULT_CPC = 9.0

# Timeline presets: name -> (span in seconds, bucket in seconds).
TIMELINES = {"1m": (60, 5), "5m": (300, 15), "1h": (3600, 60), "24h": (86400, 900)}

# Attack types a model may train on, and those kept for the generalisation check.
SEEN_ATTACKS = ["burst", "bot", "click_farm", "device_farm", "campaign_hopping"]
UNSEEN_ATTACKS = ["ip_rotation", "low_and_slow", "mimicry"]

# Rule -> (title, sentence). Braces name the value a sentence quotes.
RULE_TEXT = {
    "high_click_velocity": ("Rapid repeat clicks", "this account clicked {clicks_1m} times in the last minute{over_limit}"),
    "tiny_interval": ("Clicks too close together", "the gap between clicks fell to {min_interval}s{under_limit}"),
    "bot_user_agent": ("Automated browser", "the browser identified itself as an automation tool ({ua}) rather than a real visitor"),
    "blocked_ip": ("Blocked network", "the connection came from {ip}, which is already on the block-list"),
    "impossible_geo": ("Impossible travel", "clicks arrived from {geo_user_countries} different countries within an hour"),
    "device_sharing": ("Shared device", "{unique_users_per_device} different accounts clicked from this one device"),
    "ip_device_fanin": ("Many devices, one address", "{unique_devices_per_ip} devices sent clicks from this single network address"),
    "repeat_ad": ("Same ad over and over", "this account clicked the same advert {repeat_ad_ratio} of the time, well above normal"),
    "blocked_entity": ("Already blocked", "this account, device or network address is already blocked, so the click was rejected"),
}

# Feature -> phrase for a reader without technical background.
FACTOR_TEXT = {
    "clicks_1m": "clicks in the last minute", "clicks_5m": "clicks in the last 5 minutes",
    "clicks_1h": "clicks in the last hour", "min_interval": "shortest gap between clicks (s)",
    "repeat_ad_ratio": "share of clicks on the same ad", "unique_users_per_device": "accounts sharing this device",
    "unique_devices_per_ip": "devices behind this address", "geo_user_countries": "countries seen in the last hour",
    "ua_bot_flag": "automation signals in the browser string",
    "account_age_days": "age of the account (days)",
}

# Layer -> phrase, in the order they are tried when no rule fired.
LAYER_TEXT = {
    "rules": "the rule checks", "ml": "the fraud model", "graph": "the link graph",
    "anomaly": "the anomaly detector", "online": "the online learner",
}

# Built-in pattern conditions: key -> label.
PATTERN_LABELS = {
    "click_velocity": "Very high click rate", "tight_interval": "Machine-like timing",
    "interval_regularity": "Regular interval pattern", "bot_agent": "Automation user-agent",
    "device_farm": "Many accounts per device", "ip_fanin": "Many devices per address",
    "geo_spread": "Multiple countries at once", "repeat_ad": "Same advert over and over",
    "new_account": "Very new account", "graph_cluster": "Linked to a cluster",
    "blocked_entity": "Already blocked",
}
# --- end of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class EngineConfig:
    """All tunable settings; every operator takes one and has the published defaults."""

    rule_weights: dict = field(default_factory=lambda: dict(RULE_WEIGHTS))
    rule_limits: dict = field(default_factory=lambda: dict(RULE_LIMITS))
    blocked_ips: tuple = ()
    bot_tokens: tuple = tuple(BOT_TOKENS)
    layer_weights: dict = field(default_factory=lambda: dict(LAYER_WEIGHTS))
    level_limits: dict = field(default_factory=lambda: dict(LEVEL_LIMITS))
    graph_boost: float = 0.6
    hard_floor: float = 0.75
    horizon_s: int = 3600
    graph_ttl_s: int = 900
    block_min_hits: int = 2
    block_window_s: int = 300
    alert_gap_s: int = 300
    cluster_blocks: int = 5
    cluster_window_s: int = 120
    incident_idle_s: int = 300
    campaign_link_s: int = 120
    cpc: dict = field(default_factory=lambda: dict(CAMPAIGN_CPC))
    default_cpc: float = DEFAULT_CPC
    ip_salt: str = "fraudloom"
    retention_days: int = 7
    retention_max_events: int = 500_000
    drift_warmup_s: int = 600
    bucket_s: int = 300  # width of the time buckets that split a hot key over tasks
