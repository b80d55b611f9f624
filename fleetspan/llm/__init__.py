"""Text and packing operators for training-data pipelines on delivery-network records.

Nothing else in the library imports this subpackage; it may use the general helpers of ``fleetspan``.
"""
