"""quirefold: a Spark-native engine that cuts page text into budgeted segments."""

from quirefold.constants import ENGINE_VERSION

__version__ = ENGINE_VERSION
