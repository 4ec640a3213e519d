"""Analytics over timestamped community activity, planned by Catalyst."""
