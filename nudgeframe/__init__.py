"""Campaign-uplift analytics expressed as Spark DataFrame plans."""

from nudgeframe.config import (
    Columns,
    EvalPolicy,
    Recipe,
    SplitPolicy,
    recipe_family,
    stable_hash,
)

__all__ = [
    "Columns",
    "EvalPolicy",
    "Recipe",
    "SplitPolicy",
    "recipe_family",
    "stable_hash",
]
