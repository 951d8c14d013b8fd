"""A PySpark-native lineage analytics engine over source trees and property graphs."""
