"""Training-data operators. Each module holds one operator; ``queries`` binds
them to the driver's tables and nothing outside this folder imports them."""
