"""What an agent calls: a narrow asynchronous view of a store, and its adapter to the engine."""

from __future__ import annotations

import asyncio
from collections.abc import AsyncIterator, Callable


from mnemora.errors import MnemoraError
from mnemora.operators.context import ContextRequest
from mnemora.sources.store import ChangePoller, Engine


class MemoryProvider:
    """The twenty calls; fourteen must be given, six have answers for stores that lack them."""

    async def store_experience(self, collective_id: str, content: str, **fields) -> str:
        raise NotImplementedError

    async def get_experience(self, id: str) -> dict | None:
        raise NotImplementedError

    async def reinforce_experience(self, id: str) -> int:
        raise MnemoraError("this store doesn't reinforce")

    async def energy(self, id: str) -> float:
        raise MnemoraError("this store has no energy")

    async def search_similar(self, collective_id: str, embedding: list[float], k: int) -> list[tuple[dict, float]]:
        raise NotImplementedError

    async def get_recent(self, collective_id: str, limit: int) -> list[dict]:
        raise NotImplementedError

    async def store_relation(self, source_id: str, target_id: str, relation_type: str, strength: float = 1.0, metadata: str | None = None) -> str:
        raise NotImplementedError

    async def get_related(self, id: str) -> list[tuple[dict, dict]]:
        raise NotImplementedError

    async def store_insight(self, collective_id: str, content: str, source_experience_ids: list[str], **fields) -> str:
        raise NotImplementedError

    async def get_insights(self, collective_id: str, embedding: list[float], k: int) -> list[tuple[dict, float]]:
        raise NotImplementedError

    async def get_activities(self, collective_id: str) -> list[dict]:
        raise NotImplementedError

    async def get_context_candidates(self, collective_id: str, embedding: list[float], request: ContextRequest = ContextRequest()) -> dict[str, list[dict] | None]:
        raise NotImplementedError

    def watch(self, collective_id: str) -> AsyncIterator[dict]:
        raise NotImplementedError

    async def create_collective(self, name: str) -> str:
        raise NotImplementedError

    async def get_or_create_collective(self, name: str) -> str:
        raise NotImplementedError

    async def list_collectives(self) -> list[dict]:
        raise NotImplementedError

    async def list_experiences(self, collective_id: str, limit: int, offset: int = 0) -> list[dict]:
        return []

    async def list_relations(self, collective_id: str, limit: int, offset: int = 0) -> list[dict]:
        return []

    async def list_insights(self, collective_id: str, limit: int, offset: int = 0) -> list[dict]:
        return []

    async def list_cold_experiences(self, collective_id: str, below: float, limit: int) -> list[tuple[str, float]]:
        raise MnemoraError("this store lists no cold experiences")


class EngineProvider(MemoryProvider):
    """The calls on an engine; each runs in a thread, so the caller's loop goes on.  All lists have limits of their own."""

    def __init__(self, engine: Engine, poll_s: float = 1.0):
        self.engine, self.poll_s = engine, poll_s

    async def _rows(self, f: Callable, *args, **named) -> list[dict]:
        return await asyncio.to_thread(lambda: [r.asDict(True) for r in f(*args, **named).collect()])

    async def store_experience(self, collective_id: str, content: str, **fields) -> str:
        return await asyncio.to_thread(self.engine.record_experience, collective_id, content, **fields)

    async def get_experience(self, id: str) -> dict | None:
        return await asyncio.to_thread(self.engine.get_experience, id)

    async def reinforce_experience(self, id: str) -> int:
        return await asyncio.to_thread(self.engine.reinforce_experience, id)

    async def energy(self, id: str) -> float:
        return await asyncio.to_thread(self.engine.energy, id)

    async def search_similar(self, collective_id: str, embedding: list[float], k: int) -> list[tuple[dict, float]]:
        return [(r, r.pop("similarity")) for r in await self._rows(self.engine.search_similar, collective_id, embedding, k)]

    async def get_recent(self, collective_id: str, limit: int) -> list[dict]:
        return await self._rows(self.engine.get_recent_experiences, collective_id, limit)

    async def store_relation(self, source_id: str, target_id: str, relation_type: str, strength: float = 1.0, metadata: str | None = None) -> str:
        return await asyncio.to_thread(self.engine.store_relation, source_id, target_id, relation_type, strength, metadata)

    async def get_related(self, id: str) -> list[tuple[dict, dict]]:
        edge = ("relation_id", "relation_type", "strength", "direction", "anchor")
        return [({k: v for k, v in r.items() if k not in edge}, {k: r[k] for k in edge}) for r in await self._rows(self.engine.get_related_experiences, id)]

    async def store_insight(self, collective_id: str, content: str, source_experience_ids: list[str], **fields) -> str:
        return await asyncio.to_thread(self.engine.store_insight, collective_id, content, source_experience_ids, **fields)

    async def get_insights(self, collective_id: str, embedding: list[float], k: int) -> list[tuple[dict, float]]:
        return [(r, r.pop("similarity")) for r in await self._rows(self.engine.get_insights, collective_id, embedding, k)]

    async def get_activities(self, collective_id: str) -> list[dict]:
        return await self._rows(self.engine.get_active_agents, collective_id)

    async def get_context_candidates(self, collective_id: str, embedding: list[float], request: ContextRequest = ContextRequest()) -> dict[str, list[dict] | None]:
        def get() -> dict[str, list[dict] | None]:
            c = self.engine.get_context_candidates(collective_id, embedding, request)
            parts = {"similar": c.similar, "recent": c.recent, "insights": c.insights, "relations": c.relations, "active_agents": c.active_agents}
            return {k: None if df is None else [r.asDict(True) for r in df.collect()] for k, df in parts.items()}

        return await asyncio.to_thread(get)

    async def watch(self, collective_id: str) -> AsyncIterator[dict]:
        """Events from now on, until the caller closes the iterator."""
        poller = ChangePoller.from_sequence(await asyncio.to_thread(self.engine.get_current_sequence))
        while True:
            rows = await asyncio.to_thread(poller.poll, self.engine)
            for r in rows:
                if r["collective_id"] == collective_id:
                    yield r.asDict(True)
            if not rows:
                await asyncio.sleep(self.poll_s)

    async def create_collective(self, name: str) -> str:
        return await asyncio.to_thread(self.engine.create_collective, name)

    async def get_or_create_collective(self, name: str) -> str:
        return await asyncio.to_thread(self.engine.get_or_create_collective, name)

    async def list_collectives(self) -> list[dict]:
        return await self._rows(self.engine.list_collectives)

    async def list_experiences(self, collective_id: str, limit: int, offset: int = 0) -> list[dict]:
        return await self._rows(self.engine.list_experiences, collective_id, limit, offset)

    async def list_relations(self, collective_id: str, limit: int, offset: int = 0) -> list[dict]:
        return await self._rows(self.engine.list_relations, collective_id, limit, offset)

    async def list_insights(self, collective_id: str, limit: int, offset: int = 0) -> list[dict]:
        return await self._rows(self.engine.list_insights, collective_id, limit, offset)

    async def list_cold_experiences(self, collective_id: str, below: float, limit: int) -> list[tuple[str, float]]:
        return [(r["id"], r["energy"]) for r in await self._rows(self.engine.list_cold_experiences, collective_id, below, limit)]
