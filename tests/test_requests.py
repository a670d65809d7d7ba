import math

import pytest

from depthframe.sinks import requests


def package(name="chrM é", **more):
    return requests.Package(name, 300, 290, 5, crosses_origin=True, logarithmic=True, log_base=10, y_upper_limit=3.5, local_x=(0, 4, 15), plot_y=(1.5, None, 2.0), tick_raw_values=(0.0, 1.0), tick_display_values=(0.0, 1.0), **more)


def test_layout_of_a_request():
    data = requests.encode(requests.Request(300, 7.0, 7.0, "#1E3A8A", "#93C5FD", [package("ab")]))
    assert data[:6] == b"CXCP\x02\x00" and data[6:10] == (300).to_bytes(4, "little")
    head = 4 + 2 + 4 + 16 + 2 * (2 + 7)
    assert data[head : head + 4] == b"\x02\x00ab" and len(data) == head + 4 + 24 + 4 + 4 + 8 + 8 + 3 * 16 + 4 + 2 * 16


@pytest.mark.parametrize("grid", [False, True])
def test_round_trip(grid):
    request = requests.Request(96, 4.0, 3.0, "#000000", "#FFFFFF", [package()] * (3 if grid else 1), *((4.0, 3.0, 2, 2) if grid else ()))
    back = requests.decode(requests.encode(request))
    assert math.isnan(back.packages[0].plot_y[1]) and back.packages[0].plot_y[::2] == (1.5, 2.0)
    for p in back.packages:
        p.plot_y = (1.5, None, 2.0)
    assert back == request


def test_what_is_refused():
    good = requests.encode(requests.Request(96, 4.0, 3.0, "#000000", "#FFFFFF", [package()]))
    for bad in (b"XXXX" + good[4:], good[:4] + b"\x01" + good[5:], good[:5] + b"\x07" + good[6:], good[:-3]):
        with pytest.raises(ValueError):
            requests.decode(bad)
    with pytest.raises(ValueError):
        requests.encode(requests.Request(96, 4.0, 3.0, "x" * 70_000, "y", [package()]))
    with pytest.raises(ValueError):
        requests.encode(requests.Request(96, 4.0, 3.0, "x", "y", []))
    with pytest.raises(ValueError):
        requests.encode(requests.Request(96, 4.0, 3.0, "x", "y", [requests.Package("a", 1, 0, 0, local_x=(1,))]))
