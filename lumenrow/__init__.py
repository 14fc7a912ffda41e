"""A dynamically typed SQL dialect on Spark."""

__all__ = ["Session", "Statement"]


def __getattr__(name: str) -> object:
    if name in __all__:
        from . import session

        return getattr(session, name)
    raise AttributeError(name)
