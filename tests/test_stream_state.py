"""What a stream remembers between micro-batches."""

import pandas as pd

from tessera.streaming import health


class State:
    exists, hasTimedOut, get = False, False, None

    def update(self, value):
        self.exists, self.get = True, value

    def setTimeoutDuration(self, _):
        pass


def test_duplicates_are_known_however_late():
    state, n = State(), 12_000
    first = pd.DataFrame({"event_id": range(n), "sequence": range(n), "received_at": pd.Timestamp("2024-01-01")})
    late = pd.DataFrame({"event_id": [0], "sequence": [n], "received_at": pd.Timestamp("2024-01-02")})
    assert pd.concat(health._walk(("s",), iter([first]), state)).fault.isna().all()
    assert list(pd.concat(health._walk(("s",), iter([late]), state)).fault) == ["duplicate"]
