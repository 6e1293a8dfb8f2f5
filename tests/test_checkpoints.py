"""Checkpoints: read without their library, refused where they are more than tensors, mapped to the generator."""

import collections
import io
import math
import pickle
import sys
import types
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import inference, unet
from gridloom.sources import checkpoints


@pytest.fixture
def write(monkeypatch, tmp_path):
    """A writer of the format; stand-ins give the pickle the names that real files have."""
    package, utils = types.ModuleType("torch"), types.ModuleType("torch._utils")
    exec("def _rebuild_tensor_v2(*args): raise AssertionError", utils.__dict__)
    utils._rebuild_tensor_v2.__module__ = "torch._utils"
    for kind in checkpoints.STORAGES:
        setattr(package, kind, type(kind, (), {"__module__": "torch"}))
    monkeypatch.setitem(sys.modules, "torch", package)
    monkeypatch.setitem(sys.modules, "torch._utils", utils)
    kinds = {np.dtype(code): getattr(package, kind) for kind, code in checkpoints.STORAGES.items()}

    class Stored:
        def __init__(self, key, array):
            self.key, self.array = key, array

    class Tensor:
        def __init__(self, stored, offset, size, stride):
            self.parts = stored, offset, size, stride

        def __reduce__(self):
            return utils._rebuild_tensor_v2, (*self.parts, False, collections.OrderedDict())

    class Pickler(pickle.Pickler):
        def persistent_id(self, x):
            return ("storage", kinds[x.array.dtype], x.key, "cpu", x.array.size) if isinstance(x, Stored) else None

    def run(content, name="net.pth", order="little", root="archive", cut=0):
        stored = []

        def tensors(x):
            if isinstance(x, dict):
                return collections.OrderedDict((k, tensors(v)) for k, v in x.items())
            if isinstance(x, (np.ndarray, tuple)):
                array, offset, size, stride = x if isinstance(x, tuple) else (x.ravel(), 0, x.shape, tuple(s // x.itemsize for s in np.ascontiguousarray(x).strides if x.ndim))
                stored.append(Stored(str(len(stored)), array))
                return Tensor(stored[-1], offset, size, stride)
            return x

        out = io.BytesIO()
        Pickler(out, 2).dump(tensors(content))
        path = tmp_path / name
        with zipfile.ZipFile(path, "w") as z:
            z.writestr(f"{root}/data.pkl", out.getvalue())
            z.writestr(f"{root}/byteorder", order)
            for s in stored:
                raw = s.array.astype(s.array.dtype.newbyteorder(">" if order == "big" else "<")).tobytes()
                z.writestr(f"{root}/data/{s.key}", raw[: len(raw) - cut])
        return str(path)

    return run


def state(net: unet.UNet) -> dict:
    """The names that a training script gives to a net's parameters."""
    out, depth = {}, len(net.down)
    for kind, inner, numbered in (("encoder", "conv", list(enumerate(net.down, 1))), ("decoder", "deconv", [(depth - k, x) for k, x in enumerate(net.up)])):
        for n, layer in numbered:
            at = f"{kind}{n}" + ("" if n == 1 else f".{inner}")
            out |= {f"{at}.weight": layer["w"], f"{at}.bias": layer["b"]}
            if "norm" in layer:
                out |= {f"{kind}{n}.bn.{k}": v for k, v in layer["norm"].items()} | {f"{kind}{n}.bn.num_batches_tracked": np.array(7, np.int64)}
    return out


@pytest.mark.parametrize("order", ["little", "big"])
def test_arrays_come_back(write, order):
    rng = np.random.default_rng(1)
    content = {"a": rng.normal(size=(2, 3, 4)).astype(np.float32), "b": np.arange(5), "c": np.array(3, np.int64), "d": rng.normal(size=3).astype(np.float16), "e": np.zeros((0, 2), np.float32)}
    got = checkpoints.read(write(content, order=order))
    assert list(got) == list(content)
    assert all(np.array_equal(got[k], v) and got[k].dtype == v.dtype and got[k].shape == v.shape for k, v in content.items())


def test_views_and_wrapped_states(write):
    base = np.arange(12, dtype=np.float32)
    got = checkpoints.read(write({"epoch": 3, "state_dict": {"t": (base, 1, (3, 2), (1, 4))}}))
    assert np.array_equal(got["t"], [[1, 5], [2, 6], [3, 7]])
    assert got["t"].base is None


def test_what_is_refused(write, tmp_path):
    with pytest.raises(ValueError, match="beyond"):
        checkpoints.read(write({"t": (np.zeros(4, np.float32), 1, (4,), (1,))}))
    with pytest.raises(ValueError, match="cut short"):
        checkpoints.read(write({"t": np.zeros(4, np.float32)}, cut=4))
    with pytest.raises(ValueError, match="more than named tensors"):
        checkpoints.read(write({"t": np.zeros(4, np.float32), "rate": 0.1}))
    with pytest.raises(pickle.UnpicklingError, match="is not read"):
        checkpoints.read(write({"t": print}))
    with zipfile.ZipFile(tmp_path / "other.pth", "w") as z:
        z.writestr("x", "y")
    with pytest.raises(ValueError, match="not a zipped"):
        checkpoints.read(str(tmp_path / "other.pth"))


def test_generator_of_eight_levels_from_a_checkpoint(write):
    net = unet.fixed_weights(8, width=3, salt=2)
    path = write({f"module.{k}": v for k, v in state(net).items()})
    x = np.random.default_rng(0).normal(size=(2, 1, 256, 256)).astype(np.float32)
    z = np.linspace(-1, 1, 16, dtype=np.float32).reshape(2, 8)
    made = unet.load(path)(x, z)
    assert made.shape == x.shape and np.array_equal(made, net(x, z))


def test_states_that_do_not_fit():
    whole = state(unet.fixed_weights(3))
    for change, message in (({"encoder2.conv.weight": None}, "missing"), ({"critic.weight": np.zeros(1)}, "not a parameter"), ({"decoder2.deconv.weight": np.zeros((3, 2, 4, 4))}, "channels")):
        changed = {k: v for k, v in (whole | change).items() if v is not None}
        with pytest.raises(ValueError, match=message):
            unet.from_state(changed)
    with pytest.raises(ValueError, match="missing"):
        unet.from_state({})


def test_last_skip_is_not_rectified():
    """Only the first skip's negative part reaches the last layer."""
    net = unet.fixed_weights(2, width=1)
    x, z = np.full((1, 1, 4, 4), -3.0, np.float32), np.zeros((1, 8), np.float32)
    w0, w1, u0, u1 = net.down[0], net.down[1], net.up[0], net.up[1]
    e0 = unet.leaky(unet.convolve(np.concatenate([x, np.zeros((1, 8, 4, 4), np.float32)], 1), w0["w"], w0["b"]))
    assert (e0 < 0).any()
    inner = unet.normalise(unet.spread(np.maximum(unet.convolve(e0, w1["w"], w1["b"]), 0), u0["w"], u0["b"]), u0["norm"])
    want = np.tanh(unet.spread(np.concatenate([np.maximum(inner, 0), e0], 1), u1["w"], u1["b"]))
    assert np.allclose(net(x, z), want, atol=1e-7)


def test_heights_are_averaged_in_metres(spark):
    """Where windows differ, the mean of the decoded is not the decoded mean."""
    code = math.log(75) / 2
    image = np.random.default_rng(3).uniform(-1, 1, (4, 8)).astype(np.float32)
    px = spark.createDataFrame([(r, c, float(image[r, c])) for r in range(4) for c in range(8)], "row int, col int, value double")
    net, starts = unet.fixed_weights(2), range(0, 5, 2)
    latent = F.array(*[F.col("win_col") / 4 - 0.5] * 8)
    out = inference.infer(px, 4, 8, [net], ["v"], 4, 2, decode={"v": lambda c: F.exp((c + 1) * code)}, latent=latent)
    total, n = np.zeros((4, 8)), np.zeros((4, 8))
    for c in starts:
        made = net(image[None, None, :, c : c + 4], np.full((1, 8), c / 4 - 0.5, np.float32))[0, 0]
        total[:, c : c + 4] += np.exp((made.astype(np.float32).astype(float) + 1) * code)
        n[:, c : c + 4] += 1
    got = np.zeros((4, 8))
    for r in out.collect():
        got[r["row"], r["col"]] = r["v"]
    assert np.allclose(got, total / n, atol=1e-5)
