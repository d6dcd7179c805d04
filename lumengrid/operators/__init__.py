"""DataFrame operators over tables of images."""
