from types import SimpleNamespace as Of

from clickstrata.streaming.state import DAY_MS, Listing


class Held(dict):
    """A handle, a value and a map of keyed state, which count the calls."""

    def __init__(self):
        super().__init__()
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, *a):
        return Of(get=lambda: self.value, update=lambda v: self.call(setattr, self, "value", v), clear=lambda: self.call(setattr, self, "value", None))

    getMapState = lambda self, *a: Of(
        iterator=self.items, keys=self.keys, clear=lambda: self.call(self.clear), removeKey=lambda k: self.call(self.pop, k), updateValue=lambda k, v: self.call(self.__setitem__, k, v)
    )
    registerTimer = lambda self, t: self.call(self.timers.add, t)
    deleteTimer = lambda self, t: self.call(self.timers.remove, t)

    def call(self, f, *a):
        self.calls += 1
        f(*a)


def test_few_calls_to_the_state_and_one_timer_a_user():
    held, at = Held(), Of(getCurrentWatermarkInMs=lambda: 6 * DAY_MS)
    user = Listing(3, 0)
    user.init(held)
    rows = lambda *x: [Of(day=d, ad_id=1, n=n) for d, n in x]
    assert list(user.handleInputRows((7,), rows((5, 1), (4, 1), (8, 1)), at)) == []
    assert held.calls == 5 and held.timers == {5 * DAY_MS}
    held.timers.clear()
    assert list(user.handleExpiredTimer((7,), at, Of(getExpiryTimeInMs=lambda: 5 * DAY_MS))) == []
    assert dict(held) == {(8, 1): (1,)} and held.timers == {9 * DAY_MS}  # all days that have passed at once
    (found,) = user.handleInputRows((7,), rows((8, 2), (9, 4)), at)
    assert (found.day, found.click_count) == (8, 3) and not held and not held.timers
    assert list(user.handleInputRows((7,), rows((8, 9)), at)) == []
    fresh = Held()
    user.init(fresh)
    assert len(list(user.handleInputRows((8,), rows(*[(d, 3) for d in range(50)]), at))) == 1 and fresh.calls == 1
