"""DataFrame operators on spikes, tracks, maps, clusters and field potentials."""
