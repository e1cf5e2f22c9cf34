"""DataFrame in, DataFrame out: joins, precedence, history, network, geometry, shaping."""
