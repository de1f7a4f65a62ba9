"""Part of skylattice; see README.md."""
