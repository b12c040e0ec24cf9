"""Text generators by name, as Arrow-batched UDFs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

_GENERATORS: dict[str, tuple[Callable, dict]] = {}


def register(name: str, function: Callable[[list[str], dict], list[str]], **parameters) -> None:
    """``function`` takes prompts and parameters and returns texts; ``parameters`` are its defaults."""
    _GENERATORS[name] = (function, parameters)


def set_parameters(name: str, **parameters) -> dict:
    """Merge into the defaults; what holds from now on."""
    function, old = _GENERATORS[name]
    _GENERATORS[name] = (function, old | parameters)
    return old | parameters


def generated(prompt: Column, name: str, **parameters) -> Column:
    """Generated texts; a repeated prompt at their beginning is cut off."""
    if name not in _GENERATORS:
        raise ValueError(f"unknown generator {name!r}; one of {sorted(_GENERATORS)}")
    function, defaults = _GENERATORS[name]
    merged = defaults | parameters

    @pandas_udf("string")
    def texts(prompts: pd.Series) -> pd.Series:
        asked = prompts.fillna("").tolist()
        return pd.Series([t.removeprefix(p).strip() for p, t in zip(asked, function(asked, merged), strict=True)])

    return texts(prompt)
