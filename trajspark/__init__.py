"""Quality control, repair and recovery analytics for robot trajectories on Spark."""

from trajspark.functions.layout import Layout
from trajspark.profiles import Profile, profile_table, resolve_profile

__all__ = ["Layout", "Profile", "profile_table", "resolve_profile"]
