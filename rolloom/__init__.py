"""Rolloom: a Spark-native engine for building and analysing synthetic training sets."""

from __future__ import annotations

from importlib import import_module

__version__ = "0.1.0"

_HOME = {
    "Runner": "rolloom.runner", "Summary": "rolloom.runner", "StreamRunner": "rolloom.streaming.stateful", "RunStore": "rolloom.operators.store",
    "Machine": "rolloom.operators.transition", "Harness": "rolloom.operators.evolve", "Optimizer": "rolloom.optimizer", "Client": "rolloom.providers.client",
    "BatchProvider": "rolloom.providers.batch", "MockBatch": "rolloom.providers.batch", "RunConfig": "rolloom.sources.config", "Model": "rolloom.sources.config",
    "Acceptance": "rolloom.sources.config", "Domain": "rolloom.sources.config", "Loop": "rolloom.sources.config", "Dispatch": "rolloom.sources.config", "local_session": "rolloom.session",
}
__all__ = ["__version__", *sorted(_HOME)]


def __getattr__(name: str):
    """Names are imported when they are asked for, so that an executor that needs one module loads no more."""
    if name not in _HOME:
        raise AttributeError(name)
    return getattr(import_module(_HOME[name]), name)


def __dir__() -> list[str]:
    return __all__
