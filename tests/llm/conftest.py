import os

import pytest

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SMALL):
        pytest.skip("driver test data absent")
    return SMALL


@pytest.fixture(scope="session")
def sf_middle():
    if not os.path.isdir(MIDDLE):
        pytest.skip("driver test data absent")
    return MIDDLE
