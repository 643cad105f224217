"""Settings of the batch pipeline and of renders; driver-side only."""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass

#: Label colours as (blue, green, red), in order of class.
LABEL_COLORS = ((102, 0, 255), (255, 102, 0), (0, 255, 102), (255, 0, 102), (255, 102, 0), (0, 102, 255))
#: Named colours.
BLACK, MAGENTA, TRANSPARENT = (0.0, 0.0, 0.0), (255.0, 255.0, 255.0), (0.0, 0.0, 0.0, 0.0)
POSITIONING_MODES = ("BackgroundCentered", "FirstShot", "CenterShot", "LastShot", "AverageShot", "ShotCentered")
RESULT_MODES = ("Complete", "ShotOnly")

_flag = lambda text: bool(int(text))
_list = lambda text: tuple(x.strip() for x in text.split(",") if x.strip())


@dataclass(frozen=True)
class PipelineSettings:
    """What the batch pipeline reads from the environment; every flag holds."""

    splits: tuple[str, ...] = ("val", "train")
    input_dir: str = "."
    output_dir: str = "out"
    ortho_width: int = 70
    ortho_height: int = 70
    input_width: int = 1024
    input_height: int = 1024
    render_width: int = 2048
    render_height: int = 2048
    camera_distance: float = 10.0
    initial_skip: int = 0
    add_background: bool = True
    fovy: float = 50.0
    aspect_ratio: float = 1.0
    save_labeled_images: bool = False
    project_orthogonal: bool = False
    merge_labels: bool = True
    additional_rotations: int = 0
    rotation_limit: float = 2 * math.pi
    rotation_seed: int = -1
    rotation_limit_radian: bool = True
    apply_nms: bool = False
    nms_iou: float = 0.9
    is_thermal: bool = True
    use_onefile_corrections: bool = True
    exclude_flights: tuple[str, ...] = ()
    alpha_threshold: float = 2.0

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> "PipelineSettings":
        """Upper-cased field names; flags are 0 or 1 and lists are comma-separated."""
        env = os.environ if env is None else env
        read = {bool: _flag, int: int, float: float, str: str, tuple: _list}
        given = {n: read[type(v)](env[n.upper()]) for n, v in vars(cls()).items() if n.upper() in env}
        return cls(**given)

    @property
    def rotation_radians(self) -> float:
        return self.rotation_limit if self.rotation_limit_radian else math.radians(self.rotation_limit)


@dataclass(frozen=True)
class RenderSettings:
    count: int | None = None
    initial_skip: int = 0
    skip: int = 1
    fovy: float = 50.0
    camera_dist: float = 10.0
    positioning_mode: str = "ShotCentered"
    ortho_size: tuple[float, float] | None = None
    add_background: bool = False


@dataclass(frozen=True)
class IntegralSettings(RenderSettings):
    alpha_threshold: float = 0.1
    auto_contrast: bool = True


@dataclass(frozen=True)
class FocusSettings(IntegralSettings):
    start_focus: float = 0.0
    end_focus: float = 5.0
    frame_count: int = 5


@dataclass(frozen=True)
class ShutterSettings(IntegralSettings):
    """``shots_grow_func`` maps a frame-number Column to a Column."""

    reference_index: int = 0
    grow_symmetrical: bool = False
    shots_grow_func: Callable = lambda i: i * 0 + 1
