"""Skyloom: scene mosaics and training-data operators as Spark plans."""

import logging

__version__ = "0.2.0"
__all__ = ["SOURCE_AWS", "SOURCE_MPC", "MosaicRequest", "SceneFetchError", "mosaic", "set_log_level"]

SOURCE_AWS, SOURCE_MPC = "AWS", "MPC"


def set_log_level(level: int | str) -> None:
    """Level of the package's own messages, written to standard error."""
    log = logging.getLogger("skyloom")
    log.setLevel(level.upper() if isinstance(level, str) else level)
    if not log.handlers:
        log.addHandler(logging.StreamHandler())


def __getattr__(name: str):
    """The public names, loaded when they are first used (the package itself needs no Spark)."""
    if name == "mosaic":
        from .plans.front import mosaic

        return mosaic
    if name == "MosaicRequest":
        from .plans.request import MosaicRequest

        return MosaicRequest
    if name == "SceneFetchError":
        from .sources.retry import SceneFetchError

        return SceneFetchError
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
