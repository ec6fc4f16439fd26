"""Weights, floors and policies of the matchers, as data."""

from __future__ import annotations

# Fixed values.
LEGACY_FLOOR = 0.34  # J1
PAIR_FLOOR = 0.22  # J2
BEST_FLOOR, LOCKED_FLOOR, LIST_FLOOR, SCREEN_FLOOR = 0.45, 0.40, 0.35, 0.15  # J5, F3
SCREENED, SCORED = 60, 15
MAX_PAIRS, MAX_CANDIDATES = 80, 400
BEST_WEIGHTS = {"identifier": 0.20, "title": 0.40, "brand": 0.12, "category": 0.15, "bundle": 0.13}
PAIR_WEIGHTS = {"identifier": 0.30, "attributes": 0.25, "semantic": 0.15, "image": 0.15, "brand": 0.05, "category": 0.05, "title": 0.05}
HIGH, POSSIBLE, LOW = 0.90, 0.75, 0.55
TITLE_PREFIX = 160
POLICY = {
    "quantity": "reject", "model": "reject", "storage": "reject", "generation": "penalize", "condition": "reject", "dimensions": "reject",
    "size": "reject", "capacity": "reject", "color": "penalize", "brand": "penalize", "connectivity": "penalize", "ram": "penalize",
}
PENALTY = 0.18
CATEGORY_ATTRIBUTES = {
    "mousepad": ("brand", "model", "dimensions", "quantity", "color"),
    "ssd": ("brand", "model", "storage", "generation", "condition"),
    "phone": ("brand", "model", "storage", "generation", "connectivity", "condition", "color"),
    "tablet": ("brand", "model", "storage", "generation", "connectivity", "condition"),
    "laptop": ("brand", "model", "storage", "ram", "generation", "condition"),
    "watch": ("brand", "model", "generation", "connectivity", "condition", "color"),
    "shoes": ("brand", "model", "size", "color", "condition"),
    "apparel": ("brand", "size", "color", "condition"),
    "tumbler": ("brand", "model", "capacity", "color", "quantity", "condition"),
    "headphones": ("brand", "model", "generation", "condition", "color"),
    "flash": ("brand", "storage", "condition"),
    "ram": ("brand", "capacity", "generation", "condition"),
    "general": ("brand", "model", "quantity", "condition", "color"),
}
VARIANT_KEYS = {
    "mousepad": ("dimensions", "quantity", "color"),
    "ssd": ("storage", "generation", "condition"),
    "phone": ("storage", "generation", "connectivity", "condition", "color"),
    "tablet": ("storage", "generation", "connectivity", "condition"),
    "laptop": ("storage", "ram", "condition"),
    "watch": ("generation", "connectivity", "condition", "color"),
    "shoes": ("size", "color", "condition"),
    "apparel": ("size", "color", "condition"),
    "tumbler": ("capacity", "color", "quantity"),
    "headphones": ("generation", "condition", "color"),
    "flash": ("storage", "condition"),
    "ram": ("capacity", "generation", "condition"),
    "general": ("quantity", "condition"),
}
