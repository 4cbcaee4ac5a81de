"""Values that the tasks of a barrier stage combine while they run.

Spark's own ``allGather`` looks for its answer once a second, so it is used once: the first task tells the others its port and a
key. Then each sends its value to the first task, which combines them and sends the result back. A task that ends
closes its connection, so the others fail with it and Spark starts the stage again.
"""

from __future__ import annotations

import pickle
import secrets
import zlib
from collections.abc import Callable
from multiprocessing.connection import Client, Connection, Listener

from pyspark import BarrierTaskContext


class Exchange:
    def __init__(self, stage: BarrierTaskContext) -> None:
        self.rank, self.peers = stage.partitionId(), []
        tasks = [info.address.rsplit(":", 1)[0] for info in stage.getTaskInfos()]
        if len(tasks) == 1:
            return
        if self.rank == 0:
            key = secrets.token_bytes(16)
            with Listener(("0.0.0.0", 0), backlog=len(tasks), authkey=key) as listener:
                stage.allGather(f"{listener.address[1]} {key.hex()}")
                self.peers: list[Connection] = [listener.accept() for _ in tasks[1:]]
        else:
            port, key = stage.allGather("")[0].split()
            self.peers = [Client((tasks[0], int(port)), authkey=bytes.fromhex(key))]

    def combined(self, value: object, combine: Callable[[list], object]) -> object:
        """``combine`` of the values of all tasks, in no certain order, the same object for all."""
        if not self.peers:
            return combine([value])
        if self.rank:
            self.peers[0].send_bytes(_packed(value))
            return _unpacked(self.peers[0].recv_bytes())
        result = _packed(combine([value, *(_unpacked(p.recv_bytes()) for p in self.peers)]))
        for p in self.peers:
            p.send_bytes(result)
        return _unpacked(result)

    def close(self) -> None:
        for p in self.peers:
            p.close()


def _packed(value: object) -> bytes:
    return zlib.compress(pickle.dumps(value), 1)


def _unpacked(data: bytes) -> object:
    return pickle.loads(zlib.decompress(data))
