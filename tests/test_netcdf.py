import numpy as np
import pytest

from gridframe.sources import netcdf


def test_round_trip_2d_3d():
    a = np.arange(12, dtype=np.float32).reshape(3, 4)
    b = np.arange(24, dtype=np.float32).reshape(2, 3, 4) - 5
    raw = netcdf.dumps(
        {"depth": 2, "lat": 3, "lon": 4},
        [("cc", ["lat", "lon"], a, {"_FillValue": np.float32(1e20)}),
         ("t", ["depth", "lat", "lon"], b, {"_FillValue": np.float32(-9), "units": "K"})],
    )
    ds = netcdf.loads(raw)
    assert ds.dims == {"depth": 2, "lat": 3, "lon": 4}
    assert ds.variables["t"].shape == [2, 3, 4]
    assert np.array_equal(ds.read("cc"), a)
    assert np.array_equal(ds.read("t"), b)
    assert ds.variables["t"].attrs["units"] == "K"
    assert ds.variables["cc"].attrs["_FillValue"][0] == np.float32(1e20)


def test_rejects_non_netcdf():
    with pytest.raises(netcdf.NetCDFError):
        netcdf.loads(b"GRIB2 not a netcdf file")


def test_missing_variable():
    raw = netcdf.dumps({"x": 2}, [("v", ["x"], np.zeros(2, np.float32), {})])
    with pytest.raises(netcdf.NetCDFError):
        netcdf.loads(raw).read("w")
