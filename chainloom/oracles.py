"""DuckDB SQL of every registered query that has one."""

from chainloom.registry import ORACLES

__all__ = ["ORACLES"]
