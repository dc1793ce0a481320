"""Queries of this subpackage, by problem."""

from __future__ import annotations

import importlib

_MODULES = [
    "p1_format_duplicates",
    "p2_markup",
    "p3_personal",
    "p4_near_duplicates",
    "p5_splitting",
    "p6_encoding",
    "p7_leakage",
    "p8_mixing",
    "p9_subjects",
]


def _loaded() -> list:
    return [importlib.import_module(f"sieveworks.llm.{m}") for m in _MODULES]


def queries() -> dict:
    return {k: f for m in _loaded() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {**{k: q for m in _loaded() for k, q in m.ORACLE.items()}, **importlib.import_module("sieveworks.llm.oracles").ORACLE}
