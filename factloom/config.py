"""Retrieval settings and the presets of experiments."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

#: Fixed values of the agent: facts wanted, facts at most, rounds at most, entities to expand.
MIN_FACTS, MAX_FACTS, MAX_ITERATIONS, EXPANDED_ENTITIES = 5, 15, 5, 5
#: Passages that a hybrid result adds, facts shown to a judge, sessions kept in a result.
HYBRID_PASSAGES, JUDGED_FACTS, STORED_SESSIONS = 5, 15, 10
#: Score fusion: gains for a row of the graph, for sharing a name, and of a second source.
GRAPH_BOOST, NAME_BOOST = 0.07, 0.02


@dataclass(frozen=True)
class RetrievalSettings:
    """Two-stage search: candidates, threshold (used if above 0), results."""

    embedding_top_k: int = 20
    rerank_top_k: int = 5
    similarity_threshold: float = 0.5

    @property
    def num_results(self) -> int:
        return self.rerank_top_k


FAIR = RetrievalSettings(50, 10, 0.5)
DIRECT = RetrievalSettings(10, 10, 0.5)
NO_RERANK = RetrievalSettings(10, 10, 0.0)


@dataclass(frozen=True)
class Setup:
    """One experiment: kind of retrieval, models by role, settings."""

    name: str
    rag_type: str
    model_stack: str
    retrieval: RetrievalSettings
    reranker_type: str = "embedding"
    models: dict[str, str] = field(default_factory=dict)

    def as_dict(self) -> dict:
        return asdict(self)


#: Models by stack and role.
MODELS = {
    "gemini": {"embedding": "gemini-embedding-001", "main": "gemini-2.5-flash", "judge": "gemini-2.5-pro"},
    "gemma": {"embedding": "google/embeddinggemma-300m", "main": "google/gemma-3-27b-it", "judge": "gemini-2.5-pro"},
}
SETUPS = {
    f"{kind}_{stack}": Setup(f"{kind} {stack}", kind, stack, FAIR if (kind, stack) == ("vanilla", "gemini") else DIRECT, models=MODELS[stack])
    for kind in ("vanilla", "agentic", "hybrid")
    for stack in ("gemini", "gemma")
}


def setups_by_type(rag_type: str) -> list[Setup]:
    return [s for s in SETUPS.values() if s.rag_type == rag_type]


def setups_by_stack(model_stack: str) -> list[Setup]:
    return [s for s in SETUPS.values() if s.model_stack == model_stack]


@dataclass(frozen=True)
class Rate:
    """Requests and tokens a minute, requests a day (None: no bound)."""

    rpm: int
    tpm: int
    rpd: int | None = None

    @property
    def min_delay_seconds(self) -> float:
        return 60 / self.rpm


RATES = {"judge": Rate(15, 1_000_000, 300), "main": Rate(1000, 1_000_000, 10_000), "light": Rate(4000, 4_000_000), "embedding": Rate(1500, 10_000_000)}


def rate_of(role: str) -> Rate:
    return RATES.get(role, RATES["main"])


def next_backoff(delay: float, limited: bool, was_limited: bool, longest: float = 60.0) -> float:
    """Doubled after a limit error up to ``longest``; halved by the first success after one."""
    if limited:
        return min(longest, delay * 2)
    return delay / 2 if was_limited else delay
