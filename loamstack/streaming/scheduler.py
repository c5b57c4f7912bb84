"""The scheduler: a coalesced wake, a periodic scan, bounded batches, leases renewed beside the work."""

from __future__ import annotations

import threading
from collections.abc import Callable

from loamstack.model import CLAIM_BATCH, SCAN_SECONDS, WORK_LEASE_SECONDS


class Scheduler:
    """Runs claimed operations one after the other in a thread.

    ``claim(n)`` gives a token and ids, ``run(id)`` runs one to its end, ``renew(id, token)`` tells whether the
    lease is still held. A lost lease is told to ``lost(id)``, which should cancel the operation's Spark jobs.
    """

    def __init__(self, claim: Callable, run: Callable, renew: Callable, lost: Callable = lambda i: None, scan: float = SCAN_SECONDS, lease: float = WORK_LEASE_SECONDS, batch: int = CLAIM_BATCH):
        self._claim, self._run, self._renew, self._lost = claim, run, renew, lost
        self._scan, self._lease, self._batch = scan, lease, batch
        self._hint, self._stop = threading.Event(), threading.Event()
        self._thread = threading.Thread(target=self._loop, daemon=True)
        self.errors: list[tuple[str, Exception]] = []

    def start(self) -> Scheduler:
        self._thread.start()
        return self

    def wake(self) -> None:
        """Scan soon; any number of calls before the scan are one."""
        self._hint.set()

    def stop(self, seconds: float = 10) -> bool:
        """Finish the operation at hand; whether it ended in time."""
        self._stop.set()
        self._hint.set()
        self._thread.join(seconds)
        return not self._thread.is_alive()

    def cycle(self) -> int:
        """One scan: claim a batch and run it. A full batch asks for another scan at once."""
        token, ids = self._claim(self._batch)
        for i in ids:
            if self._stop.is_set():
                break
            self._guarded(i, token)
        if len(ids) == self._batch:
            self.wake()
        return len(ids)

    def _guarded(self, operation: str, token: str) -> None:
        done = threading.Event()

        def keep() -> None:
            while not done.wait(self._lease / 3):
                if not self._renew(operation, token):
                    self._lost(operation)
                    return

        beside = threading.Thread(target=keep, daemon=True)
        beside.start()
        try:
            self._run(operation)
        except Exception as error:  # noqa: BLE001  the operation stays resumable; its lease runs out
            self.errors.append((operation, error))
        finally:
            done.set()
            beside.join()

    def _loop(self) -> None:
        while not self._stop.is_set():
            self._hint.wait(self._scan)
            self._hint.clear()
            if not self._stop.is_set():
                self.cycle()
