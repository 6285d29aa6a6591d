"""Small configurations written for the tests."""

CAMPUS = """
hostname R1-Edge
ip dhcp pool STAFF
 network 10.10.10.0 255.255.255.0
 default-router 10.10.10.1
ip dhcp pool STUDENT
 network 10.10.20.0 255.255.255.0
 default-router 10.10.20.1
ip dhcp pool GUEST
 network 10.10.30.0 255.255.255.0
 default-router 10.10.30.1
interface GigabitEthernet0/0.10
 encapsulation dot1Q 10
 ip address 10.10.10.1 255.255.255.0
interface GigabitEthernet0/0.20
 encapsulation dot1Q 20
 ip address 10.10.20.1 255.255.255.0
 ip access-group STUDENT_IN in
interface GigabitEthernet0/0.30
 encapsulation dot1Q 30
 ip address 10.10.30.1 255.255.255.0
 ip access-group GUEST_IN in
interface GigabitEthernet0/1
 switchport mode trunk
 switchport trunk allowed vlan 10,20,30
ip access-list extended GUEST_IN
 10 deny ip 10.10.30.0 0.0.0.255 10.10.0.0 0.0.255.255
 20 permit ip any any
ip access-list extended STUDENT_IN
 10 permit tcp any host 10.0.0.9 eq 443
vlan 10
 name STAFF
vlan 20
 name STUDENT
vlan 30
 name GUEST
"""

TRUNK_GAP = """
hostname SW9
vlan 30
 name GUEST
interface Gi0/2
 switchport mode trunk
 switchport trunk allowed vlan 10,20
"""

INDENTED = """
    hostname SW2
    interface Fa0/3
     switchport mode access
     switchport access vlan 12
     switchport port-security
     switchport port-security maximum 2
    1  Po1(SU)  LACP  Fa0/1(P) Fa0/2(P)
    VLAN0012
    Fa0/1            Root FWD 19        128.1    P2p
"""

RUNTIME = """
SW1# show vlan brief
VLAN Name                             Status    Ports
10   STAFF    active    Fa0/1, Fa0/2
30   GUEST    active    Fa0/3
SW1# show interfaces trunk
Gi0/1  on  802.1q  trunking  1
Port  Vlans allowed on trunk
Gi0/1  10,20
Port  Vlans in spanning tree forwarding state and not pruned
Gi0/1  10
Extended IP access list GUEST_IN
    10 deny ip any any (24 matches)
    20 permit ip any any (0 matches)
GigabitEthernet0/1 is up, line protocol is up
  7 input errors, 2 CRC, 0 frame
  1 output errors, 0 collisions
line vty 0 4
 transport input telnet
 login local
"""
