from . import aggregates, scalars, windows

__all__ = ["aggregates", "scalars", "windows"]
