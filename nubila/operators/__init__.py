"""DataFrame operators on localization tables; `keys` names the grouping columns (cell, channel, condition)."""
