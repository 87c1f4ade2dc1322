"""The chain check of a stream: its state is read and written by batch, not by record."""

import hashlib
import random

import pandas as pd

from auditweave.operators.chains import LOG_GENESIS
from auditweave.streaming import incremental as st


class Store:
    """Stands for a handle and each of its states; counts the calls."""

    def __init__(self, calls=None):
        self.calls, self.value, self.timers = [] if calls is None else calls, None, set()

    def __getattr__(self, name):
        return getattr(Store, f"_{name}").__get__(self) if self.calls.append(name) is None else None

    def _getValueState(self, *_):  # noqa: N802
        return Store(self.calls)

    _getListState = _getMapState = _getValueState  # noqa: N815

    def _registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def _deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)

    def _exists(self):
        return self.value is not None

    def _get(self):
        return self.value or []

    def _update(self, value):
        self.value = value

    def _clear(self):
        self.value = None

    def _appendValue(self, row):  # noqa: N802
        self.value = [*(self.value or []), row]

    _put = _update

    def _updateValue(self, key, row):  # noqa: N802
        self.value = {**(self.value or {}), key: row}


class Mark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.at


def test_calls_on_the_state_do_not_follow_the_number_of_records():
    rng, records, want = random.Random(5), [], []
    for chain in ("a", "b", None, "d"):
        tail = hashlib.sha256(LOG_GENESIS.encode()).hexdigest()
        for i in range(300):
            tail = hashlib.sha256(f"{tail}s{i}".encode()).hexdigest()
            records.append((chain, 10 * i, i, f"s{i}", tail if i % 50 else "x"))
            want += [(chain, i, "broken")] if i % 50 == 0 else []
    rng.shuffle(records)
    frame = pd.DataFrame(records, columns=["chain_id", "time_ms", "id", "suffix", "record_hash"])
    check, handle = st._ChainCheck(10_000), Store()
    check.init(handle)
    rows = lambda frames: [tuple(r) for f in frames for r in f.astype(object).where(f.notna(), None).values.tolist()]
    assert rows(check.handleInputRows((1,), iter([frame[:700], frame[700:]]), Mark(0))) == []
    assert len(handle.calls) < 20 and handle.timers == {0}
    handle.timers.clear()  # it fires
    first = rows(check.handleExpiredTimer((1,), Mark(1505), None))
    assert sorted(first, key=repr) == sorted((w for w in want if w[1] <= 150), key=repr) and handle.timers == {1510}
    late = frame[(frame.id == 7) & (frame.chain_id == "b")]
    assert rows(check.handleInputRows((1,), iter([late]), Mark(1505))) == [("b", 7, "late")] and handle.timers == {1510}
    handle.timers.clear()
    assert sorted(rows(check.handleExpiredTimer((1,), Mark(5000), None)), key=repr) == sorted((w for w in want if w[1] > 150), key=repr) and handle.timers == {12_990}
    handle.timers.clear()
    assert sorted(rows(check.handleExpiredTimer((1,), Mark(12_990), None)), key=repr) == sorted(((c, 299, "expired") for c in ("a", "b", None, "d")), key=repr)
    assert handle.timers == set() and len(handle.calls) < 80
